"""Comparing a directory snapshot with the registry by name and fingerprint.

Both sides are unique on ``name``: a directory cannot hold two files of one name,
and ``read_registry`` leaves one row per name. Joins therefore carry no hot key.
They move names and fingerprints only; text is fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.operators.registry import read_registry, with_fingerprint
from ledgerframe.session import materialize


def ignored_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.where(~N.is_valid_name(F.col("name")))


def valid_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.where(N.is_valid_name(F.col("name")))


def quarantined_scripts(scripts: DataFrame) -> DataFrame:
    """Valid scripts that have no place in the order, with the reason: they must not run."""
    odd = scripts.where(N.is_quarantined(F.col("name")))
    return odd.withColumn("reason", F.lit("order number out of range"))


def development_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.where(N.order_number(F.col("name")) < N.DEVELOPMENT_LIMIT)


def directory_keys(directory: DataFrame, sized: bool = False) -> DataFrame:
    size = [F.octet_length("text").alias("dir_bytes")] if sized else []
    return with_fingerprint(valid_scripts(directory)).select(
        "name", F.col("file_hash").alias("dir_hash"), *size
    )


def registry_keys(registry: DataFrame, sized: bool = False) -> DataFrame:
    """Everything a comparison needs of the latest row of each name, but not its text.

    A registry without ids, such as the result of ``next_registry``, is unique on the name.
    """
    facts = [c for c in ("type", "status") if c in registry.columns]
    if "script_id" not in registry.columns:
        registry = registry.withColumn("script_id", F.lit(0).cast("bigint"))
    size = [F.octet_length("text").alias("reg_bytes")] if sized else []
    slim = with_fingerprint(registry).select("script_id", "name", "file_hash", *facts, *size)
    return read_registry(slim).withColumnRenamed("file_hash", "reg_hash")


def compare(directory: DataFrame, registry: DataFrame, sized: bool = False) -> DataFrame:
    """Both sides in one full outer join, with the registry facts of known names.

    ``sized`` adds the bytes of both texts, ``dir_bytes`` and ``reg_bytes``.
    """
    joined = directory_keys(directory, sized).join(registry_keys(registry, sized), "name", "full_outer")
    change = (
        F.when(F.col("reg_hash").isNull(), "new")
        .when(F.col("dir_hash").isNull(), "deleted")
        .when(F.col("dir_hash") != F.col("reg_hash"), "updated")
        .otherwise("unchanged")
    )
    return joined.withColumn("change", change)


def reconcile(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, change, dir_hash, reg_hash) for every name of either side."""
    return compare(directory, registry).select("name", "change", "dir_hash", "reg_hash")


def change_summary(directory: DataFrame, registry: DataFrame) -> DataFrame:
    name = F.col("name")
    return (
        reconcile(directory, registry)
        .groupBy("change", N.script_type(name).alias("type"), N.schema_type(name).alias("schema_type"))
        .agg(F.count(F.lit(1)).alias("n_scripts"))
    )


def new_scripts(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Valid scripts of the directory that the registry has no row of.

    Their names are found and written first: a short list is then broadcast, so texts stay in place.
    """
    known = registry.select("name").distinct()
    fresh = valid_scripts(directory).select("name").join(known, "name", "left_anti")
    return fresh if directory.columns == ["name"] else directory.join(materialize(fresh, "fresh"), "name", "left_semi")


def deleted_names(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Names known to the registry and gone from the directory, with their type."""
    known = registry.select("name").distinct()
    gone = known.join(valid_scripts(directory).select("name"), "name", "left_anti")
    return gone.withColumn("type", N.script_type(F.col("name")))


def deleted_scripts(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows, one per name, whose file is gone.

    Names are folded and compared first; rows are then fetched by name and id, a key no
    repeated name makes heavy.
    """
    latest = read_registry(registry.select("script_id", "name"))
    gone = latest.join(valid_scripts(directory).select("name"), "name", "left_anti")
    return registry.join(gone, ["name", "script_id"], "left_semi")


def _both(directory: DataFrame, registry: DataFrame) -> DataFrame:
    return directory_keys(directory).join(registry_keys(registry), "name")


def updated_scripts(directory: DataFrame, registry: DataFrame) -> DataFrame:
    """Changed files: directory text wins, the registry id is kept.

    What has changed is written first, without texts, so that Spark knows when it is short.
    """
    changed = _both(directory, registry).where("dir_hash <> reg_hash")
    fields = ["name", "text"] + [c for c in ("ts",) if c in directory.columns]
    slim = materialize(changed.select("name", "script_id", F.col("dir_hash").alias("file_hash")), "updated")
    return directory.select(*fields).join(slim, "name")


def unchanged_scripts(directory: DataFrame, registry: DataFrame) -> DataFrame:
    same = _both(directory, registry).where("dir_hash = reg_hash")
    return same.select("name", "script_id", F.col("dir_hash").alias("file_hash"))


def orphaned_rollbacks(
    directory: DataFrame, registry: DataFrame, raise_on: bool = False
) -> DataFrame:
    """Deleted forward scripts whose rollback file is still in the directory."""
    commits = deleted_names(directory, registry).where(F.col("type") == N.COMMIT)
    wanted = commits.select("name", N.rollback_name(F.col("name")).alias("rollback_name"))
    present = valid_scripts(directory).select(F.col("name").alias("rollback_name"))
    found = wanted.join(present, "rollback_name", "left_semi").select("name", "rollback_name")
    if raise_on and not found.isEmpty():
        raise ValueError("forward scripts were deleted but their rollbacks remain")
    return found


def pair_names(deleted: DataFrame, strict: bool = False) -> DataFrame:
    """(name, commit_name): deleted rollbacks whose forward script is deleted too.

    Several rollbacks may resolve to one forward name; each is its own pair.
    """
    rollbacks = deleted.where(F.col("type") == N.ROLLBACK).select(
        "name", N.commit_name(F.col("name"), strict).alias("commit_name")
    )
    names = deleted.select(F.col("name").alias("commit_name"))
    return rollbacks.join(names, "commit_name", "left_semi").select("name", "commit_name")


def paired_rollbacks(directory: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    return pair_names(deleted_names(directory, registry), strict)


def unpaired_deletions(directory: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Deleted rows in no pair; they outlive a forced rollback run."""
    deleted = deleted_names(directory, registry)
    pairs = pair_names(deleted, strict)
    members = pairs.select("name").union(pairs.select("commit_name")).distinct()
    return deleted.join(members, "name", "left_anti")
