"""A registry kept in step with arriving scripts, as a log of merged runs of files.

A batch writes only what it changes: one run, dealt into buckets by name. After every ``FANOUT``
batches its runs are merged into one, after every ``FANOUT``^2 those, and so on, so that the registry
after n batches is at most (FANOUT - 1) * log n runs, newest first, over the seed. A batch looks up its
names alone, in their buckets alone, without texts.

A run is named by the versions it holds; batch n writes version n + 1. The runs that make up a version
follow from the names: always the longest run that ends last. A batch repeated after a failure reads
the same runs and overwrites its own. Runs that were merged are removed when the batch after the merge
comes, as nothing can ask for them any more.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerframe.operators import reconcile as R
from ledgerframe.operators.registry import bootstrap_registry, read_registry, with_fingerprint
from ledgerframe.operators.skew import union_all

REGISTRY_FIELDS = ["name", "file_hash", "text", "type", "status"]
REGISTRY_SCHEMA = "name string, file_hash string, text string, type int, status int, version bigint, bucket int"
#: Buckets of a registry, fixed when it is seeded, and runs of one level that become one.
BUCKETS = 64
FANOUT = 8
RUN = re.compile(r"run=(\d+)-(\d+)-(\d+)$")


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int"))


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored_runs(spark: SparkSession, root: str) -> dict[tuple[int, int], int]:
    """(first version, last version) -> buckets, of the complete runs: a handful, whatever the registry."""
    fs, path = _folder(spark, root)
    found = {}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        named = RUN.search(status.getPath().getName())
        if named and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[int(named[1]), int(named[2])] = int(named[3])
    return found


def cover(runs, upto: int | None = None) -> list[tuple[int, int]]:
    """The runs that make up a version (the last one, if none is named), newest first."""
    left = [r for r in runs if upto is None or r[1] <= upto]
    chosen = []
    while left:
        best = max(left, key=lambda r: (r[1], -r[0]))
        chosen.append(best)
        left = [r for r in left if r[1] < best[0]]
    return chosen


def run_path(root: str, run: tuple[int, int], buckets: int) -> str:
    return f"{root}/run={run[0]}-{run[1]}-{buckets}"


def write_run(rows: DataFrame, root: str, run: tuple[int, int], buckets: int) -> None:
    """Rows with their version, one file per bucket."""
    placed = bucketed(rows, buckets).repartition("bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(run_path(root, run, buckets))


def write_version(changes: DataFrame, root: str, version: int, buckets: int = BUCKETS) -> None:
    """The rows that one batch adds or changes."""
    write_run(changes.select(*REGISTRY_FIELDS).withColumn("version", F.lit(version).cast("bigint")), root, (version, version), buckets)


def seed_registry(registry: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write version 0, the registry the stream starts from."""
    write_version(read_registry(with_fingerprint(registry)).select(*REGISTRY_FIELDS), root, 0, buckets)


def read_runs(spark: SparkSession, root: str, runs: list[tuple[int, int]], buckets: int) -> DataFrame:
    frames = [spark.read.schema(REGISTRY_SCHEMA).parquet(run_path(root, run, buckets)) for run in runs]
    return union_all(frames) if frames else spark.createDataFrame([], REGISTRY_SCHEMA)


def read_buckets(spark: SparkSession, root: str, runs: list[tuple[int, int]], buckets: int, only: list[int]) -> DataFrame:
    """The rows that runs have in some buckets. Folders of others are neither listed nor planned."""
    frames = []
    for run in runs:
        path = run_path(root, run, buckets)
        fs, folder = _folder(spark, path)
        stored = {status.getPath().getName() for status in fs.listStatus(folder)}
        own = [f"{path}/bucket={b}" for b in only if f"bucket={b}" in stored]
        if own:
            frames.append(spark.read.schema(REGISTRY_SCHEMA).option("basePath", path).parquet(*own))
    return union_all(frames) if frames else spark.createDataFrame([], REGISTRY_SCHEMA)


def buckets_of(spark: SparkSession, root: str) -> int:
    return next(iter(stored_runs(spark, root).values()), BUCKETS)


def registry_versions(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """Rows of the runs that make up a version; ``latest`` folds them."""
    runs = stored_runs(spark, root)
    return read_runs(spark, root, cover(runs, upto), next(iter(runs.values()), BUCKETS)).drop("bucket")


def latest(versions: DataFrame) -> DataFrame:
    """The registry: the newest row of each name."""
    return read_registry(versions, version="version").drop("version")


def compact_registry(spark: SparkSession, root: str, new_root: str) -> None:
    """Fold all versions into version 0 of a new root, between two runs of the stream.

    The stream goes on with the new root and its old checkpoint; batch numbers rise on.
    """
    write_version(latest(registry_versions(spark, root)).select(*REGISTRY_FIELDS), new_root, 0, buckets_of(spark, root))


def absorb_scripts(batch: DataFrame, versions: DataFrame) -> DataFrame:
    """Registry rows a batch of arriving scripts adds or changes.

    A change keeps the type and status on record. A name that arrives twice in one
    batch counts once: the later file, or without times the larger text.
    """
    pick = F.max_by("text", F.struct("ts", "text")) if "ts" in batch.columns else F.max("text")
    arrived = bootstrap_registry(R.valid_scripts(batch).groupBy("name").agg(pick.alias("text")))
    # the newest row of a name by an aggregate over slim columns: known names never meet their texts
    facts = F.struct("file_hash", "type", "status")
    known = versions.groupBy("name").agg(F.max_by(facts, "version").alias("known"))
    marked = arrived.join(known, "name", "left")
    changed = marked.where(F.col("known").isNull() | (F.col("known.file_hash") != F.col("file_hash")))
    kept = {c: F.coalesce(f"known.{c}", c).alias(c) for c in ("type", "status")}
    return changed.select("name", "file_hash", "text", kept["type"], kept["status"])


def looked_up(batch: DataFrame, root: str, upto: int) -> DataFrame:
    """What is on record, slim, in the buckets of the batch's names."""
    spark = batch.sparkSession
    runs = stored_runs(spark, root)
    buckets = next(iter(runs.values()), BUCKETS)
    arriving = bucketed(batch.select("name"), buckets).select("bucket").distinct()
    wanted = [row["bucket"] for row in arriving.collect()]  # at most all buckets
    known = read_buckets(spark, root, cover(runs, upto), buckets, sorted(wanted))
    return known.select("name", "file_hash", "type", "status", "version")


def merge_span(version: int, fanout: int = FANOUT) -> int:
    """How many versions the run that ends here holds: the largest power of the fan-out that divides it."""
    span = 1
    while version and version % (span * fanout) == 0:
        span *= fanout
    return span


def merge_runs(spark: SparkSession, root: str, version: int, fanout: int = FANOUT) -> None:
    """Merges the runs of the last versions where it is their turn."""
    first = version - merge_span(version, fanout) + 1
    if first == version:
        return
    runs = stored_runs(spark, root)
    buckets = next(iter(runs.values()), BUCKETS)
    parts = [r for r in cover(runs, version) if r[0] >= first]
    if len(parts) > 1:
        newest = read_registry(read_runs(spark, root, parts, buckets).drop("bucket"), version="version")
        write_run(newest.select(*REGISTRY_FIELDS, "version"), root, (first, version), buckets)


def drop_merged(spark: SparkSession, root: str, upto: int) -> None:
    """Removes runs that a run of a finished batch has taken in."""
    runs = stored_runs(spark, root)
    live = cover(runs, upto)
    fs, _ = _folder(spark, root)
    for run, buckets in runs.items():
        if run not in live and any(a <= run[0] and run[1] <= b for a, b in live):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(run_path(root, run, buckets)), True)


def reconcile_stream(scripts: DataFrame, root: str, checkpoint: str, fanout: int = FANOUT) -> StreamingQuery:
    """Keep a registry in step with scripts arriving on a stream of (name, text).

    Deletions cannot be seen by a stream of arrivals; ``deleted_scripts`` stays a
    batch operator.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # that this batch is here means that the one before is finished
        drop_merged(spark, root, batch_id)
        changes = absorb_scripts(batch, looked_up(batch, root, batch_id))
        write_version(changes, root, batch_id + 1, buckets_of(spark, root))
        merge_runs(spark, root, batch_id + 1, fanout)

    return (
        scripts.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
