"""Joins and ordered concatenation that hold up when one key owns much of the data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.session import materialize

# A key with at least this many rows leaves the shuffle path. The list of such
# keys has at most (rows / HOT_ROWS) entries, which is what bounds its broadcast:
# 10^12 rows can have 200,000 of them.
HOT_ROWS = 5_000_000

# A part of a document holds fragments that start within so many characters, and so many
# fragments, of each other. The borders depend on the places of the fragments alone.
MAX_DOCUMENT_CHARS = 64 << 20
PART_ROWS = 1 << 16


# Bytes of text that a task of a join by name reads about.
TASK_BYTES = 64 << 20


def dealt_by_bytes(slim: DataFrame, keys: list[str], size: int | None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The slim side of a join with texts of ``size`` bytes, in partitions that keep a task's share of them small.

    The other side of a join that shuffles follows. Where Spark's own number of partitions is enough,
    nothing is done, and a slim side that is short is broadcast as before.
    """
    parts = -(-(size or 0) // task_bytes)
    own = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(parts, *keys) if parts > own else slim


def join_counted(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    rows: str = "n_rows",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right``, which is unique on ``keys`` and counts left's rows.

    ``right[rows]`` is the number of rows ``left`` has per key, a by-product of
    the aggregate that made ``right``. Keys at or above ``hot_rows`` are joined by
    broadcast, so their rows stay where they were read; all others are shuffled.
    ``how`` is ``inner`` or ``left``; both branches together give the whole join.
    When no key is hot, adaptive execution drops the first branch.
    """
    hot = F.broadcast(right.where(F.col(rows) >= hot_rows))
    cold = right.where(F.col(rows) < hot_rows)
    from_hot = left.join(hot, keys, "inner")
    rest = left.join(hot.select(*keys), keys, "left_anti")
    return from_hot.unionByName(rest.join(cold, keys, how))


def ordered_text(
    fragments: DataFrame,
    keys: list[str],
    order: list[Column],
    text: str = "text",
    max_chars: int = MAX_DOCUMENT_CHARS,
    part_rows: int = PART_ROWS,
    opens_with: int | None = None,
    chars: str | None = None,
    each: Callable[[Column], Column] | None = None,
    parts: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """Concatenate the fragments of each key in order: (keys, part, text).

    A fragment's part follows from its place in the document alone: the characters in front of
    it over ``max_chars``, plus the fragments in front of it over ``part_rows``. The parts of a
    document, in ascending order, spell it; most documents have part 0 only. Null texts add
    nothing. With ``opens_with``, documents whose lowest value of the first order column is
    another one are left out. A ``chars`` column with the approximate length of each text
    saves making the text in the pass that finds documents of several parts. ``each`` is a last
    rule for the text of documents of one part, ``parts`` one for the frame of all others.

    Documents that have one part by that rule are gathered by key. The fragments of the others
    are range-partitioned, and places are counted within partitions and then across them, so
    that no task gathers more than a part.
    """
    places = [c.alias(f"o{i}") for i, c in enumerate(order)]
    length = F.coalesce((F.length(text) if chars is None else F.col(chars)).cast("bigint"), F.lit(0))
    sizes = (
        fragments.select(*keys, order[0].alias("o0"), length.alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("rows"), F.min("o0").alias("opening"))
    )
    # Slim and written, so that Spark knows its size and picks the joins below.
    several = materialize(sizes.where((F.col("chars") >= max_chars) | (F.col("rows") > part_rows)), "several")
    pieces = fragments.select(*keys, length.alias("n"), F.struct(*places, F.col(text).alias("text")).alias("piece"))
    columns = [*keys, "part", "text"]

    def spelled(frame: DataFrame, by: list[str]) -> DataFrame:
        gathered = frame.groupBy(*by).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
        if opens_with is not None and by == keys:
            gathered = gathered.where(F.col("pieces")[0]["o0"] == opens_with)
        joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
        return gathered.select(*by, joined.alias("text"))

    def whole(frame: DataFrame) -> DataFrame:
        made = spelled(frame, keys).withColumn("part", F.lit(0).cast("bigint"))
        return made.withColumn("text", each(F.col("text")) if each else F.col("text")).select(columns)

    if several.isEmpty():
        return whole(pieces)
    wanted = several if opens_with is None else several.where(F.col("opening") == opens_with)
    parted = _parted(pieces.join(wanted.select(*keys), keys, "left_semi"), keys, len(order), max_chars, part_rows)
    cut = spelled(parted, [*keys, "part"]).select(columns)
    return whole(pieces.join(several, keys, "left_anti")).unionByName(parts(cut, keys) if parts else cut)


def _parted(pieces: DataFrame, keys: list[str], width: int, max_chars: int, part_rows: int) -> DataFrame:
    """The pieces with the part that each belongs to."""
    ranged = (
        pieces.repartitionByRange(*keys, *[F.col(f"piece.o{i}") for i in range(width)])
        .sortWithinPartitions(*keys, "piece")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("stretch", F.shiftright("at", 33))
    )
    # Written, as the places must not change when a task is run again.
    ranged = materialize(ranged, "ranged")
    # A window's group is what one partition has of a key, or one row per partition.
    inside = Window.partitionBy("stretch", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    stretches = ranged.groupBy("stretch", *keys).agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("rows"))
    before = stretches.select(
        "stretch",
        *keys,
        F.coalesce(F.sum("chars").over(across), zero).alias("chars_before"),
        F.coalesce(F.sum("rows").over(across), zero).alias("rows_before"),
    )
    chars = F.col("chars_before") + F.coalesce(F.sum("n").over(inside), zero)
    rows = F.col("rows_before") + F.count(F.lit(1)).over(inside)
    part = F.floor(chars / max_chars) + F.floor(rows / part_rows)
    return ranged.join(before, ["stretch", *keys]).withColumn("part", part.cast("bigint"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
