"""Shards of near-equal bytes by fixed virtual slots.

A record's slot is a hash of its id; the number of slots never changes. Bytes are summed per
slot, and a map, one row per slot and version, says which shard has which slot. The first
version deals slots from the largest down, each to the emptiest shard. Later versions are edits:
slots leave shards that are too full, or go to new shards, and all others stay where they are.
Every version is a folder of its own below the map's path, never written twice, and records are
placed by what is read from there.

An id that many rows share, or that is missing, would make a slot too big for any dealing. An
edit marks such a slot as ``spread``: its records go by a hash of their row instead, all others
stay in their slots. ``FULL_SHARE`` of a shard is the bound, so at most shards / ``FULL_SHARE``
slots are spread.

The map has ``SLOTS`` rows per version whatever the data, so it is dealt on the driver and
broadcast; the records themselves are never regrouped by shard.

Defined results: a null text has only the overhead as its size and the crc of no bytes; a very
long text counts whole, and only its size and crc move. Rows with a null id are rows of one id.
Repeated rows have places of their own, in the order of the rows as they were read; they share a
slot unless it is spread. Columns that are not asked for are ignored, whatever their names. An
empty table gives an empty result and a map all the same.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import numbered
from ledgerframe.session import materialize

SLOTS = 8192
OVERHEAD = 16
#: Bytes beyond its largest record that a slot may have, as a share of a shard's mean.
FULL_SHARE = 0.25
MAP = "version int, virtual_slot int, shard int, spread boolean"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> dict[int, int]:
    """Bytes of each slot that has any; at most ``slots`` rows."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return {r["virtual_slot"]: r["bytes"] for r in sums.collect()}


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """slot -> shard: the largest slot first, always to the emptiest shard."""
    heap = [(0, shard) for shard in range(shards)]
    dealt = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, shard = heap[0]
        dealt[slot] = shard
        heapq.heapreplace(heap, (load + sizes.get(slot, 0), shard))
    return dealt


def rebalanced(dealt: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards and the slots' present bytes.

    Only slots of shards above the mean move, each to the emptiest shard, largest first as long
    as it fits below the mean there.
    """
    edited = dict(dealt)
    loads = dict.fromkeys(range(shards), 0)
    for slot, shard in edited.items():
        loads[shard] = loads.get(shard, 0) + sizes.get(slot, 0)
    mean = sum(loads.values()) / shards
    for slot in sorted(edited, key=lambda s: (-sizes.get(s, 0), s)):
        size, source = sizes.get(slot, 0), edited[slot]
        target = min(range(shards), key=lambda k: (loads[k], k))
        if source >= shards or (size and loads[source] - size >= mean and loads[target] + size <= mean):
            loads[source] -= size
            loads[target] += size
            edited[slot] = target
    return edited


def versions(spark, maps: list[dict[int, int]], spread: frozenset[int] = frozenset(), start: int = 0) -> DataFrame:
    """version, virtual_slot, shard, spread: one row per version and slot, numbered from ``start``."""
    rows = [(number, slot, shard, slot in spread) for number, dealt in enumerate(maps, start) for slot, shard in sorted(dealt.items())]
    return spark.createDataFrame(rows, MAP)


def store(spark, path: str, version: int, dealt: dict[int, int], spread: frozenset[int] = frozenset()) -> None:
    """Writes a version of the map; one that is there already is an error."""
    told = versions(spark, [dealt], spread, version).drop("version")
    told.coalesce(1).write.parquet(f"{path}/version={version}")


def stored(spark, path: str) -> DataFrame:
    """All versions of the map at ``path``."""
    return spark.read.schema(MAP).parquet(path)


def sized(docs: DataFrame, overhead: int = OVERHEAD, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot (by id) and _row, written once: the only pass over texts."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("virtual_slot"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return materialize(slim, "sized")


def in_slots(records: DataFrame, dealt: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The records, those of spread slots with a slot by row as their ``virtual_slot``."""
    spread = F.broadcast(dealt.filter("spread").select("virtual_slot", F.lit(True).alias("_spread")))
    own = F.when(F.col("_spread"), slot_of(F.col("_row"), slots)).otherwise(F.col("virtual_slot"))
    return records.join(spread, "virtual_slot", "left").withColumn("virtual_slot", own).drop("_spread")


def full_slots(records: DataFrame, shards: int) -> frozenset[int]:
    """Slots whose records, but for the largest, pass ``FULL_SHARE`` of a shard's mean bytes."""
    mean = (records.agg(F.sum("size")).first()[0] or 0) / shards
    sums = records.groupBy("virtual_slot").agg((F.sum("size") - F.max("size")).alias("rest"))
    return frozenset(r["virtual_slot"] for r in sums.filter(F.col("rest") > FULL_SHARE * mean).collect())


def deal(records: DataFrame, path: str, shards: int, slots: int = SLOTS) -> int:
    """Stores version 0 of the map, dealt from the bytes of the slots."""
    store(records.sparkSession, path, 0, first_map(slot_bytes(records), shards, slots))
    return 0


def rebalance(records: DataFrame, path: str, version: int, shards: int, slots: int = SLOTS) -> int:
    """Stores the version after ``version``: its map with full slots spread, edited for the present bytes."""
    spark = records.sparkSession
    known = stored(spark, path).filter(F.col("version") == version).collect()
    spread = frozenset(r["virtual_slot"] for r in known if r["spread"]) | full_slots(records, shards)
    before = {r["virtual_slot"]: r["shard"] for r in known}
    sizes = slot_bytes(in_slots(records, versions(spark, [before], spread), slots))
    store(spark, path, version + 1, rebalanced(before, sizes, shards), spread)
    return version + 1


def sharded(records: DataFrame, maps: DataFrame, version: int, slots: int = SLOTS) -> DataFrame:
    """The records with ``shard`` by one version of the stored maps, and ``slot``, their place there."""
    dealt = maps.filter(F.col("version") == version).drop("version")
    owned = in_slots(records, dealt, slots).join(F.broadcast(dealt.drop("spread")), "virtual_slot")
    placed = numbered(owned, "shard", "doc_id", "text_crc32", "_row", name="_place")
    # one row per shard
    starts = placed.groupBy("shard").agg(F.min("_place").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_place") - F.col("_start")).drop("_place", "_start", "_row")
