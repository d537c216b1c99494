"""Row keys, global positions and text batches shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.session import materialize

#: Stands for a missing doc_id wherever documents are ordered: after all others.
LAST = 2**63 - 1


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with further columns by name; other columns are dropped."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def column_of(frame: DataFrame, name: str, alias: str = "") -> str:
    """The column's declaration in a schema string."""
    return f"{alias or name} {frame.schema[name].dataType.simpleString()}"


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``texts`` with a unique ``row`` per row and its place ``ord`` in document order.

    Where doc_id is unique and never null both are doc_id. Else rows are numbered once and
    written to the shared folder, so that a recomputed task can't number them anew.
    """
    found = texts(docs, *more)
    ids = found.groupBy("doc_id").count()
    odd = ids.filter((F.col("count") > 1) | F.col("doc_id").isNull()).limit(1).count()
    if not odd:
        return found.withColumns({"row": F.col("doc_id"), "ord": F.col("doc_id")})
    numbered = found.withColumns({"row": F.monotonically_increasing_id(), "ord": F.coalesce("doc_id", F.lit(LAST))})
    return materialize(numbered, "rows")


def numbered(frame: DataFrame, *order, name: str = "position") -> DataFrame:
    """Gapless numbers from 0 in the given order, without a window over all rows.

    The rows are range-partitioned and written in order; counts of the partitions, one row
    each, give the first number of every partition.
    """
    spark = frame.sparkSession
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition: bounded by the partition count, never by the data
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.withColumn("_first", F.coalesce(before, F.lit(0))).drop("_rows")
    firsts = spark.createDataFrame(firsts.collect(), firsts.schema)
    joined = placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, F.col("_first") + inside).drop("_at", "_part", "_first")


def byte_batches(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and the n + 1 borders of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), borders - borders[0]
    return np.frombuffer(data, np.uint8)[borders[0] : borders[-1]], borders - borders[0]


def release() -> None:
    """Hands memory that a task has freed back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Recent:
    """Results by piece of text, of bounded number: two generations, of which the older is
    forgotten when the younger is full. What is used again moves to the younger."""

    def __init__(self, limit: int, longest: int):
        self.limit, self.longest = limit, longest
        self.now: dict = {}
        self.before: dict = {}

    def unknown(self, pieces: set[str]) -> list[str]:
        """The pieces without a result; those of the older generation are taken over."""
        fresh = pieces.difference(self.now)
        # asked for one by one: an intersection with a dict walks all of the dict
        known = [piece for piece in fresh if piece in self.before]
        self.now.update((piece, self.before[piece]) for piece in known)
        return list(fresh.difference(known))

    def trim(self, fresh: list[str]) -> None:
        """Drops the long ones of the fresh pieces, and starts a generation if this one is full."""
        for piece in fresh:
            if len(piece) > self.longest:
                del self.now[piece]
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
