"""Reading, checking and changing the registry of known scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import names as N


def read_registry(registry: DataFrame, key: str = "name", version: str = "script_id") -> DataFrame:
    """One row per name, the highest id.

    Ids are unique. The highest ones are found in a hash aggregate over names and ids, so
    text is neither sorted nor aggregated.
    """
    latest = registry.groupBy(key).agg(F.max(version).alias(version))
    return registry.join(latest, [key, version], "left_semi").select(*registry.columns)


def registry_duplicates(registry: DataFrame) -> DataFrame:
    """Violations of the unique key (name, file_hash)."""
    counted = registry.groupBy("name", "file_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where("n_rows > 1")


def registry_count(registry: DataFrame) -> DataFrame:
    """Row count and whether the next run would be the first one."""
    return registry.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "first_run", F.col("n_rows") == 0
    )


def bootstrap_registry(scripts: DataFrame) -> DataFrame:
    """First run: every valid script is registered as executed, none is run."""
    name, text = F.col("name"), F.col("text")
    kept = [c for c in ("text", "ts") if c in scripts.columns]
    return scripts.where(N.is_valid_name(name)).select(
        "name",
        N.fingerprint(text).alias("file_hash"),
        *kept,
        N.script_type(name).alias("type"),
        F.lit(N.EXECUTED).alias("status"),
    )


def with_fingerprint(scripts: DataFrame) -> DataFrame:
    if "file_hash" in scripts.columns:
        return scripts
    return scripts.withColumn("file_hash", N.fingerprint(F.col("text")))


def apply_changes(
    registry: DataFrame,
    inserts: DataFrame | None = None,
    updates: DataFrame | None = None,
    deletes: DataFrame | None = None,
    gone: DataFrame | None = None,
) -> DataFrame:
    """The next version of a registry that is unique on ``name``.

    An update replaces fingerprint, text and time and nothing else; deletes go by
    name; inserts are new names. Rows that stay are kept by an anti join with the list of
    changed names, which is short where changes are few, so their text can stay in place. ``gone``
    is that list, the names of updates and deletes, where it is at hand as a table without texts.
    """
    result = registry
    lists = [frame.select("name") for frame in (deletes, updates) if frame is not None]
    if lists:
        listed = gone if gone is not None else reduce(DataFrame.unionByName, lists).distinct()
        result = registry.join(listed.select("name"), "name", "left_anti")
    if updates is not None:
        fields = [c for c in ("file_hash", "text", "ts") if c in updates.columns and c in registry.columns]
        before = registry.drop(*fields)
        if deletes is not None:
            before = before.join(deletes.select("name").distinct(), "name", "left_anti")
        changed = before.join(updates.select("name", *fields), "name").select(*registry.columns)
        result = result.unionByName(changed)
    if inserts is not None:
        result = result.unionByName(inserts, allowMissingColumns=True)
    return result


def semi_filter(frame: DataFrame, keys: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """Keep (or drop) the rows whose key is listed; an empty list matches nothing.

    ``frame`` is unique on ``on`` (a primary key); the list may repeat keys.
    """
    listed = keys.select(*on).distinct()
    return frame.join(listed, on, "left_semi" if keep else "left_anti")
