"""Near-duplicate documents by order min-hash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with how often it has
occurred before, so that no label repeats. A sketch takes the ``PICKED`` labels with the least
hashes of one hash function and keeps them in text order: it agrees for two documents about as
often as they agree in shingles and in their order. Documents with an equal sketch are candidates.
A document of at most ``FEW`` shingles has keys instead that any document like it shares for certain.

Similarity is the best alignment of the two sequences over the longer one's length: the longest
chain of equal labels in order, within the band of diagonals that 0.8 leaves. As labels don't
repeat, that is a longest increasing run of places.

Copies are one document here. In a bucket of equal sketches all documents are compared with
the least; those unlike it are compared with the least of the rest, and so on, ``ROUNDS`` times.
Then any two documents of a bucket that the links leave in different components are compared, in
blocks that are spread over tasks. So neither the number of partners is capped nor all pairs of a
group of alike documents are made. Classes are connected components of the links.

Defined results: a null text is empty. Documents without a word are alike only if their texts
are equal; below five words the words are the only shingle. Extra columns are ignored; an empty
table gives an empty result; rows with equal ids are rows of their own. A text is read whole by
one task, at some 40 bytes of memory for a byte.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import byte_batches, keyed
from ledgerframe.llm.suffix_dedup import _powers, mixed
from ledgerframe.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 48
PICKED = 5
FEW = 20
KEYED = 3
ROUNDS = 3
BLOCK = 64
U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every word of a text's bytes, in order."""
    up, down, table = _powers(1 << max(21, len(data).bit_length()))
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * down[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * up[start] + (end - start).astype(U))


def labels(text: str) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles, in text order; they don't repeat."""
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    shingle = np.zeros(len(words) - size + 1, U)
    for i in range(size):
        shingle = mixed(shingle + words[i : len(words) - size + 1 + i])
    order = np.argsort(shingle, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = shingle[order][1:] != shingle[order][:-1]
    first = np.flatnonzero(new)
    occurrence = np.empty(len(order), U)
    occurrence[order] = (np.arange(len(order)) - first[np.cumsum(new) - 1]).astype(U)
    return mixed(shingle + occurrence * U(0x9E3779B97F4A7C15))


def sketches(label: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """One number per hash function: the least labels in text order."""
    random = np.random.default_rng(10)
    seeds = random.integers(0, 1 << 32, count, np.uint32)
    picked = min(picked, len(label))
    short, found = (label >> U(32)).astype(np.uint32), np.empty(count, U)
    step = max(1, (1 << 20) // len(label))
    for i in range(0, count, step):
        value = (short[None, :] ^ seeds[i : i + step, None]) * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA77)
        if picked < len(label):
            place = np.sort(np.argpartition(value, picked - 1, axis=1)[:, :picked], axis=1)
        else:
            place = np.tile(np.arange(picked), (len(value), 1))
        code = np.full(len(value), 0, U) + np.arange(i, i + len(value), dtype=U)
        for column in label[place].T:
            code = mixed(code + column)
        found[i : i + step] = code
    return found


def keys(label: np.ndarray, picked: int = KEYED) -> np.ndarray:
    """Numbers of which two documents of alike sequences have one in common for certain.

    Alike documents share ``need`` labels or more. The least ``picked`` of these are among the least
    ``len(label) - need + picked`` labels of both, so every choice from those is a key.
    """
    size = len(label)
    need = next(n for n in range(size + 1) if n / size >= SIMILARITY)
    picked = min(picked, size)
    least = np.sort(label)[: size - need + picked]
    code = np.full(1, SKETCHES + picked, U)
    for column in least[np.array(list(combinations(range(len(least)), picked)))].T:
        code = mixed(code + column)
    return code


def candidacies(label: np.ndarray) -> np.ndarray:
    """The buckets of a document: keys, sketches, or both where its partners may have either."""
    if not len(label):
        return np.zeros(0, U)
    found = [keys(label)] if len(label) <= FEW / SIMILARITY else []
    return np.concatenate([*found, *([sketches(label)] if len(label) > FEW else [])])


def similarity(one: np.ndarray, two: np.ndarray) -> float:
    """The longest banded chain of equal labels over the longer length; 0 where below the threshold
    is certain."""
    longest = max(len(one), len(two))
    if not longest or min(len(one), len(two)) < SIMILARITY * longest:
        return 0.0
    by_one, by_two = np.argsort(one), np.argsort(two)
    at = np.searchsorted(one[by_one], two[by_two])
    at[at == len(one)] = 0
    same = one[by_one[at]] == two[by_two]
    first, second = by_one[at[same]], by_two[same]
    near = np.abs(first - second) <= (1 - SIMILARITY) * longest + 1
    first, second = first[near], second[near]
    if len(first) < SIMILARITY * longest:
        return 0.0
    second = second[np.argsort(first)]
    if (np.diff(second) > 0).all():
        return len(second) / longest
    tails: list[int] = []
    for place in second.tolist():
        i = bisect_left(tails, place)
        tails[i : i + 1] = [place]
    return len(tails) / longest


def sketched(rows: DataFrame) -> DataFrame:
    """row, one, two (hashes of the text) and sketches or keys of every document; written once."""

    def sketch(batches):
        for batch in byte_batches(batches):
            found = [candidacies(x) for x in map(labels, batch.column(3).to_pylist())]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["row", "one", "two", "sketches"])

    named = rows.select("row", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"), "text")
    return materialize(named.mapInArrow(sketch, "row long, one long, two long, sketches array<long>"), "sketches")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """leader, row, similar of the pairs, by alignment; written once."""
    leaders = texts.select(F.col("row").alias("leader"), F.col("text").alias("leader_text"))
    both = pairs.join(texts, "row").join(leaders, "leader").select("leader", "row", "leader_text", "text")

    def verify(batches):
        held, own = None, None
        for batch in byte_batches(batches):
            leader, row = (batch.column(i).to_pylist() for i in (0, 1))
            found = []
            for i, number in enumerate(leader):
                if number != held:
                    held, own = number, labels(batch.column(2)[i].as_py())
                found.append(similarity(own, labels(batch.column(3)[i].as_py())) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([pa.array(leader, pa.int64()), pa.array(row, pa.int64()), pa.array(found, pa.bool_())], names=["leader", "row", "similar"])

    return materialize(both.mapInArrow(verify, "leader long, row long, similar boolean"), "verified")


def unjoined(seen: DataFrame, buckets: DataFrame, known: DataFrame) -> DataFrame:
    """bucket, row, label, block and blocks to meet, of the buckets whose documents are in several components.

    The documents of a bucket's largest component make blocks of their own, which meet the others'
    blocks only. Buckets of the same documents are taken once.
    """
    labelled = seen.select("bucket", "row").join(buckets, "bucket", "left_semi").join(known.withColumnRenamed("node", "row"), "row", "left")
    labelled = materialize(labelled.withColumn("label", F.coalesce("label", "row")), "labelled")
    named = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"rows{i}") for i in range(2)]
    groups = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"), *named)
    sums = [F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), *(F.bit_xor(f"rows{i}").alias(f"rows{i}") for i in range(2))]
    mixed_ = groups.groupBy("bucket").agg(*sums, F.count("*").alias("labels")).filter("labels > 1")
    once = mixed_.groupBy("n", "rows0", "rows1").agg(F.min(F.struct("bucket", "most")).alias("at")).select("n", "at.*")
    few, many = (F.ceil(n / BLOCK).cast("int") for n in (F.col("n") - F.col("most.n"), F.col("most.n")))
    once = once.select("bucket", F.col("most.label").alias("largest"), few.alias("few"), many.alias("many"))
    number, own = F.xxhash64("row"), F.col("label") == F.col("largest")
    block = F.when(own, F.col("few") + F.pmod(number, F.col("many"))).otherwise(F.pmod(number, F.col("few"))).cast("int")
    meets = F.when(own, F.col("few")).otherwise(F.col("few") + F.col("many"))
    return labelled.join(once, "bucket").select("bucket", "row", "label", block.alias("block"), meets.alias("meets"))


def in_blocks(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between documents of a bucket that are in different components, compared in pairs of
    blocks. A pair of blocks gives only links that join two components."""
    other = F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other")
    dealt = rest.select("bucket", "row", "label", "block", other)
    dealt = dealt.select("row", "label", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), F.xxhash64("bucket", "block").alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        rows, sides, names = (table[name].to_pylist() for name in ("row", "side", "label"))
        own = [labels(text) for text in table["text"].to_pylist()]
        one_block = len(set(sides)) == 1
        joined = {name: name for name in names}

        def root(name: int) -> int:
            while joined[name] != name:
                joined[name] = name = joined[joined[name]]
            return name

        links = []
        for i in range(len(rows)):
            for j in range(i):
                if not one_block and sides[i] == sides[j]:
                    continue
                one, two = root(names[i]), root(names[j])
                if one != two and similarity(own[i], own[j]) >= SIMILARITY:
                    joined[one] = two
                    links.append((rows[i], rows[j]))
        return pa.table({"leader": pa.array([a for a, _ in links], pa.int64()), "row": pa.array([b for _, b in links], pa.int64())})

    return materialize(dealt.join(texts, "row").groupBy("unit").applyInArrow(compare, "leader long, row long"), "blocks")


def components_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, label: components by the links between documents of equal sketches (bucket, row)."""
    found, links, seen, open_ = None, [], [], members
    for _ in range(ROUNDS):
        leaders = open_.groupBy("bucket").agg(F.min("row").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
        led = open_.join(leaders, "bucket").filter("row != leader")
        pairs = led.select("leader", "row").distinct()
        if found is not None:
            pairs = pairs.join(found, ["leader", "row"], "left_anti")
        told = verified(pairs, texts)
        links.append(told.filter("similar").select("leader", "row"))
        found = told if found is None else found.unionByName(told)
        seen.append(materialize(led.join(found, ["leader", "row"]).select("bucket", "row", "similar"), "seen"))
        # a bucket goes on with the documents unlike its leader
        open_ = seen[-1].filter("not similar").select("bucket", "row")
        rest = open_.groupBy("bucket").count().filter("count > 1").select("bucket")
        if rest.isEmpty():
            break
    linked = reduce(DataFrame.unionByName, links)
    known = components(linked)
    # documents like a leader have not met those unlike it, and the rest has not met at all
    led = reduce(DataFrame.unionByName, seen).filter("similar").select("bucket")
    buckets = seen[0].filter("not similar").select("bucket").distinct().join(led.unionByName(rest), "bucket", "left_semi")
    more = in_blocks(unjoined(seen[0], buckets, known), texts)
    return known if more.isEmpty() else components(linked.unionByName(more))


def components(links: DataFrame, one: str = "leader", two: str = "row") -> DataFrame:
    """node, label: the least node of each connected component, by least labels of neighbours
    and jumps to the label's label; every round is written."""
    edges = links.select(F.col(one).alias("node"), F.col(two).alias("next"))
    edges = materialize(edges.unionByName(edges.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct(), "edges")
    known = materialize(edges.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("label")), "labels")
    while True:
        near = edges.join(known.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("label").alias("near"))
        lower = known.join(near, "node").select("node", F.least("label", "near").alias("lower"), "label")
        jump = known.select(F.col("node").alias("lower"), F.col("label").alias("jump"))
        moved = lower.join(jump, "lower", "left").select("node", F.least("lower", F.coalesce("jump", "lower")).alias("label"), F.col("label").alias("before"))
        moved = materialize(moved, "labels")
        known = moved.drop("before")
        if moved.filter("label != before").isEmpty():
            return known


def near_classes(docs: DataFrame, *more: str) -> DataFrame:
    """The rows of ``keyed`` with ``class``: the least row that each is alike with, by chains of
    links or of equal texts."""
    rows = keyed(docs, *more)
    sketch = sketched(rows)
    copies = sketch.groupBy("one", "two").agg(F.min("row").alias("first"))
    same = materialize(sketch.select("row", "one", "two").join(copies, ["one", "two"]).select("row", "first"), "copies")
    firsts = sketch.join(copies.select(F.col("first").alias("row")), "row", "left_semi")
    bucketed = firsts.select("row", F.explode("sketches").alias("bucket"))
    shared = bucketed.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = materialize(bucketed.join(shared, "bucket", "left_semi"), "members")
    texts = materialize(rows.select("row", "text").join(members.select("row").distinct(), "row", "left_semi"), "candidates")
    known = components_of(members, texts)
    classes = same.join(known, same["first"] == known["node"], "left").select("row", F.coalesce("label", "first").alias("class"))
    return rows.drop("text").join(classes, "row")
