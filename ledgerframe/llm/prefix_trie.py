"""The trie of conversation prefixes, aggregated by ROLLUP.

A conversation is laid out as blocks of ``WIDTH`` positional turn-id columns. ``GROUP BY block,
start, ROLLUP(t1, ..., tn)`` then aggregates all prefixes of all blocks together, and grouping_id
says how deep a row lies in its block. ``start`` is the node where the block before ended: a digest
of all turns in front, so long conversations continue in further blocks without a loop over depths.
Identical prefixes combine before the shuffle, however many conversations share them.

A node is known by its smallest member and its depth. The nodes whose smallest member is
conversation c are the last ones of c's path, without a gap. Subtrees therefore need no walk: what
lies below a node is all that its other members own, and what its smallest member owns from here on.
A second ROLLUP sums what members own; a running sum along each path takes off what lies above.

Turn ids are 128 bits of the SHA-256 of role and text, a prefix's digest is the exclusive-or of
two 64-bit hashes of its (position, turn id) pairs. Texts are read once, for ids and lengths.
Positions, digests of prefixes and running sums are counted in stretches first and then across
them, so a conversation that holds much of the table is still dealt over many tasks; the ids of
conversations that end at one node are joined in pieces, and hashed piece after piece.

Defined results: null roles and texts are empty; null turns come first; turns of one number go by
their ids' digest, repeated rows stay repeated. Rows without conv_id belong to no conversation and
are left out. Very long conversations and texts are whole. A table without rows has no nodes.
Columns other than those four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.operators.skew import join_counted
from ledgerframe.session import materialize

#: Turn columns of a block.
WIDTH = 8
#: Positions that one task counts or sums in a row.
STRETCH = 1 << 15


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key, chars: turns in order, numbered without a window over a conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("key"), F.length(text).cast("long").alias("chars")
    )
    slim = materialize(slim, "turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # written, as the places must not change when a task is run again
    placed = materialize(placed.drop("turn").withColumn("part", F.shiftright("at", 33)), "placed")
    inside = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # one row per conversation and partition that holds some of it
    ahead = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = inside.select("conv_id", "part", (F.coalesce(ahead, F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = placed.join(starts, ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return numbered.select("conv_id", "pos", "key", "chars")


def spliced(turns: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, pos, key, chars of conversations rebuilt on a shared head.

    Conversation c gets the first h turns of conversation c - c % family, then its own turns after
    its first h; h is crc32(c) % heads. A conversation without turns has one row with a null key.
    """
    turns = materialize(turns, "numbered")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("rows"))
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    base = F.col("conv_id") - F.col("conv_id") % F.lit(family)
    known = lengths.withColumns({"h": head, "base": base})
    heads_of = lengths.select(F.col("conv_id").alias("base"), F.col("rows").alias("base_rows"))
    known = known.join(heads_of, "base", "left")
    known = materialize(known.withColumn("taken", F.least("h", F.coalesce("base_rows", F.lit(0)))), "known")

    firsts = turns.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    lent = known.filter("taken > 0").join(firsts, "base").filter(F.col("pos") <= F.col("taken"))
    own = join_counted(turns, known.select("conv_id", "h", "taken", "rows"), ["conv_id"], rows="rows")
    own = own.filter(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    none = known.filter((F.col("taken") == 0) & (F.col("rows") <= F.col("h")))
    turnless = none.select("conv_id", F.lit(1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("chars"))
    columns = ["conv_id", "pos", "key", "chars"]
    return lent.select(columns).unionByName(own.select(columns)).unionByName(turnless)


def running(frame: DataFrame, key: str, order: str, values: dict[str, str], how, zero: int = 0) -> DataFrame:
    """Adds, as ``values``' names, the aggregate ``how`` of its columns over the earlier rows of the key."""
    frame = frame.withColumn("_stretch", (F.col(order) / F.lit(STRETCH)).cast("long"))
    inside = Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = frame.groupBy(key, "_stretch").agg(*[how(c).alias(c) for c in values.values()])
    earlier = sums.select(key, "_stretch", *[how(c).over(across).alias(f"_{n}") for n, c in values.items()])
    # most keys have one stretch, and nothing in front of it
    earlier = earlier.filter("_stretch > 0")
    here = frame.select("*", *[F.coalesce(how(c).over(inside), F.lit(zero)).alias(n) for n, c in values.items()])
    joined = here.join(earlier, [key, "_stretch"], "left")
    combine = (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)
    both = {n: combine(F.col(n), F.coalesce(f"_{n}", F.lit(zero))) for n in values}
    return joined.withColumns(both).drop("_stretch", *[f"_{n}" for n in values])


def lanes(pos: Column, key: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at a place; no turn gives 0."""
    none = F.lit(0).cast("long")
    return (
        F.when(key.isNull(), none).otherwise(F.xxhash64(pos, key)),
        F.when(key.isNull(), none).otherwise(F.xxhash64(key, pos, F.lit("b"))),
    )


def turn_blocks(rebuilt: DataFrame) -> DataFrame:
    """conv_id, block, a and b (the node it starts from), t1..tn: turn ids with the length of their text."""
    place = F.pmod(F.col("pos") - 1, F.lit(WIDTH))
    block = ((F.col("pos") - 1 - place) / WIDTH).cast("long")
    one, two = lanes(F.col("pos"), F.col("key"))
    turn = F.when(F.col("key").isNotNull(), F.struct("key", "chars"))
    laid = (
        rebuilt.withColumns({"block": block, "place": place, "one": one, "two": two, "turn": turn})
        .groupBy("conv_id", "block")
        .agg(
            F.bit_xor("one").alias("one"),
            F.bit_xor("two").alias("two"),
            *[F.max(F.when(F.col("place") == i, F.col("turn"))).alias(f"t{i + 1}") for i in range(WIDTH)],
        )
    )
    return running(laid, "conv_id", "block", {"a": "one", "b": "two"}, F.bit_xor)


def rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """depth, a, b (the node), above_a, above_b (its parent), chars and the aggregates, per prefix."""
    names = [f"t{i + 1}" for i in range(WIDTH)]
    columns = ", ".join(names)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, a, b, {columns}, grouping_id() AS gid, {aggregates} FROM {{blocks}} GROUP BY block, a, b, ROLLUP({columns})",
        blocks=blocks,
    )
    # grouping_id has one bit for each turn column that is rolled up
    inside = sum((F.when(F.col("gid").bitwiseAND(1 << i) == 0, 1).otherwise(0) for i in range(WIDTH)), F.lit(0))
    rolled = rolled.withColumn("inside", inside)
    last = F.element_at(F.array(*names), F.greatest("inside", F.lit(1)))
    # the start of a later block is the end of the one before; a shorter conversation has no turn here
    rolled = rolled.withColumn("last", last).filter(
        ((F.col("inside") == 0) & (F.col("block") == 0)) | ((F.col("inside") > 0) & F.col("last.key").isNotNull())
    )
    depth = F.col("block") * WIDTH + F.col("inside")
    steps = [lanes(F.col("block") * WIDTH + (i + 1), F.when(F.col("inside") > i, F.col(f"{names[i]}.key"))) for i in range(WIDTH)]
    top = lanes(depth, F.when(F.col("inside") > 0, F.col("last.key")))
    node = [reduce(lambda x, y: x.bitwiseXOR(y), [s[lane] for s in steps], F.col("ab"[lane])) for lane in (0, 1)]
    chars = F.when(F.col("inside") > 0, F.col("last.chars")).otherwise(F.lit(0).cast("long"))
    taken = {"block", "a", "b", "gid", "inside", "last", *names}
    kept = [c for c in rolled.columns if c not in taken]
    found = rolled.select(depth.alias("depth"), node[0].alias("a"), node[1].alias("b"), chars.alias("chars"), top[0].alias("top_a"), top[1].alias("top_b"), *kept)
    # the parent's digest is the node's without its last turn
    above = {f"above_{lane}": F.col(lane).bitwiseXOR(F.col(f"top_{lane}")) for lane in "ab"}
    return found.withColumns(above).drop("top_a", "top_b")


def ends(rebuilt: DataFrame) -> DataFrame:
    """depth, a, b of each node at which conversations end, and the SHA-256 of their joined ids."""
    one, two = lanes(F.col("pos"), F.col("key"))
    length = F.max(F.when(F.col("key").isNotNull(), F.col("pos")).otherwise(F.lit(0)))
    last = rebuilt.groupBy("conv_id").agg(length.alias("depth"), F.bit_xor(one).alias("a"), F.bit_xor(two).alias("b"))
    ranged = last.repartitionByRange("depth", "a", "b", "conv_id").withColumn("part", F.spark_partition_id())
    # a piece is what one range holds of a node; ranges are in order of conv_id
    pieces = ranged.groupBy("depth", "a", "b", "part").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "a", "b", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    sorted_pieces = pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "part")
    return sorted_pieces.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its pieces in order; only the digest of the open node is held."""
    node, digest = None, None
    names = ["depth", "a", "b", "ends_sha256"]

    def batch_of(rows):
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("depth", "a", "b", "ids")), strict=True):
            if key == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield batch_of(done)
    if node is not None:
        yield batch_of([(*node, digest.hexdigest())])


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of all prefixes of (conv_id, pos, key, chars), as the module says."""
    rebuilt = materialize(rebuilt, "rebuilt")
    blocks = materialize(turn_blocks(rebuilt), "blocks")
    node = ["depth", "a", "b"]
    nodes = rolled_up(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs")
    nodes = materialize(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    # a node has one child per node that names it as parent; children of one node may be very many
    above = [(F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b")]
    children = nodes.filter("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    placed = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    placed = materialize(placed, "placed")

    # what the smallest member of nodes owns: the saving of all of them, and at most one leaf
    owned = placed.groupBy("conv_id").agg(
        F.sum("own").alias("owned"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"), F.count("*").alias("rows")
    )
    weighed = join_counted(blocks, owned, ["conv_id"], rows="rows")
    below = rolled_up(weighed, "sum(owned) AS below, sum(leaf) AS n_leaves").select(*node, "below", "n_leaves")
    path = running(placed, "conv_id", "depth", {"over": "own"}, F.sum)
    summed = path.join(below, node).withColumn("saved_tokens", F.col("below") - F.col("over"))

    parents = placed.filter("n_children > 0").select(
        F.col("depth").alias("up"), F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows")
    )
    named = join_counted(summed.withColumn("up", F.col("depth") - 1), parents, ["up", "above_a", "above_b"], how="left")
    none = F.lit(hashlib.sha256().hexdigest())
    ended = named.join(ends(rebuilt), node, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return ended.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
