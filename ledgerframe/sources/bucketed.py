"""A registry as a table of buckets, of which a new version rewrites only those that change.

Rows are dealt into buckets by a hash of their name. A version is a manifest: for every bucket the
version that wrote its rows. A commit reads and writes the buckets of changed names, points at older
versions for all others, and takes effect when its manifest gets its name, which is one rename: before
that, readers see the old version, and an interrupted commit leaves only files that nothing points at.
Of two commits on one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ledgerframe.operators.registry import apply_changes
from ledgerframe.session import materialize

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another commit has made the version that this one was about to make."""


def bucket_of(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def _publish(spark: SparkSession, root: str, version: int, manifest: dict) -> None:
    """Writes a manifest, a few kilobytes whatever the table, and gives it its name."""
    folder, fs = _path(spark, f"{root}/manifest")
    fs.mkdirs(folder)
    draft, _ = _path(spark, f"{root}/manifest/.draft-{uuid.uuid4().hex}")
    final, _ = _path(spark, f"{root}/manifest/{version}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise ConflictError(f"version {version} exists already")


def versions(spark: SparkSession, root: str) -> list[int]:
    folder, fs = _path(spark, f"{root}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest_of(spark: SparkSession, root: str, version: int) -> dict:
    row = spark.read.text(f"{root}/manifest/{version}.json", wholetext=True).first()
    return json.loads(row["value"])


def _data(root: str, version: int) -> str:
    return f"{root}/data/version={version}"


def create(registry: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Version 0: all rows of a registry that is unique on ``name``.

    There are some times as many partitions as buckets, so that few buckets share a task.
    """
    spark = registry.sparkSession
    dealt = registry.withColumn("bucket", bucket_of(F.col("name"), buckets)).repartition(4 * buckets, "bucket")
    dealt.write.partitionBy("bucket").parquet(_data(root, 0))
    schema = json.loads(registry.schema.json())
    _publish(spark, root, 0, {"buckets": [0] * buckets, "schema": schema, "rewritten": buckets})
    return 0


def read(spark: SparkSession, root: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version (the last, if none is named), or of some of its buckets, with their bucket."""
    number = versions(spark, root)[-1] if version is None else version
    manifest = manifest_of(spark, root, number)
    schema = StructType.fromJson(manifest["schema"]).add("bucket", IntegerType())
    homes: dict[int, list[int]] = {}
    for bucket, home in enumerate(manifest["buckets"]):
        if only is None or bucket in only:
            homes.setdefault(home, []).append(bucket)
    frames = [spark.read.schema(schema).parquet(_data(root, home)).where(F.col("bucket").isin(own)) for home, own in homes.items()]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def commit(
    spark: SparkSession,
    root: str,
    inserts: DataFrame | None = None,
    updates: DataFrame | None = None,
    deletes: DataFrame | None = None,
    base: int | None = None,
) -> int:
    """Applies changes to a version (the last, if none is named) and returns the number of the next.

    Decisions are taken on names. Rows that stay are copied from their bucket to its next version
    where they are read; the list of changed names is written first, so Spark knows when it is short.
    """
    number = versions(spark, root)[-1] if base is None else base
    manifest = manifest_of(spark, root, number)
    buckets = len(manifest["buckets"])
    given = [f for f in (inserts, updates, deletes) if f is not None]
    if not given:
        return number

    def marked(frames: list[DataFrame], gone: bool) -> list[DataFrame]:
        return [f.select("name", F.lit(gone).alias("gone")) for f in frames]

    gone = [f for f in (updates, deletes) if f is not None]
    named = marked([] if inserts is None else [inserts], False) + marked(gone, True)
    names = reduce(DataFrame.unionByName, named).groupBy("name").agg(F.max("gone").alias("gone"))
    changed = materialize(names.withColumn("bucket", bucket_of(F.col("name"), buckets)), "changed")
    touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most all buckets
    old = read(spark, root, number, touched)

    def written(frame: DataFrame | None) -> DataFrame | None:
        return None if frame is None else materialize(frame, "changes")

    # the anti join takes the names of the slim list: those of written changes count with their texts
    after = apply_changes(old.drop("bucket"), written(inserts), written(updates), written(deletes), changed.where("gone"))
    placed = after.withColumn("bucket", bucket_of(F.col("name"), buckets))
    home = f"{_data(root, number + 1)}-{uuid.uuid4().hex}"
    placed.write.partitionBy("bucket").parquet(home)
    own = home.rsplit("=", 1)[1]
    homes = [own if b in touched else old_home for b, old_home in enumerate(manifest["buckets"])]
    _publish(spark, root, number + 1, {**manifest, "buckets": homes, "rewritten": len(touched)})
    return number + 1
