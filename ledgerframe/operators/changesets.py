"""Files and commits of change sets, and the package scripts they regenerate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import text as T

MERGE_MARK = "Merge branch 'master' into"
NON_PACKAGE_WARNING = "Some changed definitions lie outside of the package folder."
ROLLBACK_FILE = "_rollback.sql"


def filter_commits(commits: DataFrame) -> DataFrame:
    """(change_id, pos, sha, action): merges from the main branch are skipped."""
    merge = F.coalesce(F.col("message").contains(MERGE_MARK), F.lit(False))
    usable = commits.where(F.col("sha").isNotNull() & (F.col("sha") != ""))
    return usable.select(
        "change_id", "pos", "sha", F.when(merge, "skipped").otherwise("kept").alias("action")
    )


def classify_files(files: DataFrame, root: str = "db") -> DataFrame:
    """Flag each file by the case-sensitive folder it lies in."""
    name = F.col("filename")
    in_ddl, in_packages = name.startswith(f"{root}/ddl/"), name.startswith(f"{root}/ddl/packages/")
    return files.withColumns(
        {
            "in_db": name.startswith(f"{root}/"),
            "in_scripts": name.startswith(f"{root}/scripts/"),
            "in_packages": in_packages,
            "non_package_ddl": in_ddl & ~in_packages,
        }
    )


def change_warnings(files: DataFrame, root: str = "db") -> DataFrame:
    """One warning per change set that has definitions outside the package folder."""
    flagged = classify_files(files, root).where("non_package_ddl")
    return flagged.select("change_id").distinct().withColumn("warning", F.lit(NON_PACKAGE_WARNING))


def file_base(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def detect_packages(files: DataFrame, root: str = "db") -> DataFrame:
    """Distinct (change_id, package_name) from the changed package files."""
    base = file_base(F.col("filename"))
    package = F.lower(F.regexp_replace(base, r"(_spec)?\.sql\z", ""))
    hit = F.col("in_packages") & base.endswith(".sql")
    return (
        classify_files(files, root).where(hit).select("change_id", package.alias("package_name")).distinct()
    )


def script_name_parts(filename: Column) -> dict[str, Column]:
    """number, branch, package_name and is_rollback of a change script.

    All parts but the flag are null when the name is no script name.
    """
    base = file_base(filename)
    is_rollback = base.endswith(ROLLBACK_FILE)
    stem = F.regexp_replace(base, r"(_rollback)?\.sql\z", "")
    parts = F.split(stem, "_")
    good = base.endswith(".sql") & (F.size(parts) >= 2)
    package = F.lower(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), "_"))
    return {
        "number": F.when(good, F.get(parts, 0)),
        "branch": F.when(good, F.get(parts, 1)),
        "package_name": F.when(good, package),
        "is_rollback": is_rollback,
    }


def parse_change_script(files: DataFrame, root: str = "db") -> DataFrame:
    """Parsed script files of a change set; unparsable names are flagged, not lost."""
    scripts = classify_files(files, root).where("in_scripts").select("change_id", "pos", "filename")
    parsed = scripts.withColumns(script_name_parts(F.col("filename")))
    return parsed.withColumn("is_valid", F.col("number").isNotNull())


def change_candidates(files: DataFrame, rollback: bool, root: str = "db") -> DataFrame:
    """The script to regenerate per (change_id, package): the last file named for it.

    The last file is picked by an aggregate that combines before the shuffle, so the
    join with the detected packages sees one row per key on both sides.
    """
    parsed = parse_change_script(files, root).where(
        F.col("is_valid")
        & (F.col("is_rollback") == rollback)
        & (F.col("package_name") != "")
        & F.col("number").rlike(r"^[0-9]+\z")
    )
    # Leading zeros go, as the number is written back as a number.
    number = F.coalesce(F.nullif(F.regexp_replace("number", "^0+", ""), F.lit("")), F.lit("0"))
    last = parsed.groupBy("change_id", "package_name").agg(
        F.max_by(F.struct("filename", number.alias("number"), "branch"), F.col("pos")).alias("last")
    )
    packages = detect_packages(files, root)
    return last.join(packages, ["change_id", "package_name"], "left_semi").select(
        "change_id",
        "package_name",
        file_base(F.col("last.filename")).alias("script_name"),
        F.col("last.number").alias("number"),
        F.col("last.branch").alias("branch"),
    )


def compose_package_script(sources: DataFrame) -> DataFrame:
    """One script per package source; ``is_valid`` is false where the spec is missing."""
    return sources.select(
        "edition",
        "package_name",
        T.compose_package(F.col("spec"), F.col("body")).alias("text"),
        F.col("spec").isNotNull().alias("is_valid"),
    )


def rewrite_year_range(sources: DataFrame, year: int) -> DataFrame:
    columns = [T.rewrite_year_range(F.col(c), year).alias(c) for c in ("spec", "body")]
    return sources.select("edition", "package_name", *columns)


def regenerate_scripts(files: DataFrame, sources: DataFrame, year: int, root: str = "db") -> DataFrame:
    """(change_id, file_name, text): rollbacks from the old edition, scripts from the new.

    Sources are unique per edition and package. A package that very many change sets
    touch makes the candidate side heavy on one key; adaptive skew handling splits it.
    """
    results = []
    for rollback, edition in ((True, "before"), (False, "after")):
        wanted = change_candidates(files, rollback, root)
        composed = compose_package_script(sources.where(F.col("edition") == edition))
        text = F.col("text") if rollback else T.rewrite_year_range(F.col("text"), year)
        suffix = ROLLBACK_FILE if rollback else ".sql"
        file_name = F.concat("number", F.lit("_"), "branch", F.lit("_"), "package_name", F.lit(suffix))
        joined = wanted.join(composed.where("is_valid"), "package_name")
        results.append(
            joined.select(
                "change_id",
                "package_name",
                F.lit(rollback).alias("is_rollback"),
                file_name.alias("file_name"),
                text.alias("text"),
            )
        )
    return results[0].unionByName(results[1])


def missing_sources(files: DataFrame, sources: DataFrame, root: str = "db") -> DataFrame:
    """(change_id, package_name, is_rollback) of scripts that cannot be made for want of a spec."""
    results = []
    for rollback, edition in ((True, "before"), (False, "after")):
        usable = sources.where((F.col("edition") == edition) & F.col("spec").isNotNull())
        wanted = change_candidates(files, rollback, root).select("change_id", "package_name")
        absent = wanted.join(usable.select("package_name"), "package_name", "left_anti")
        results.append(absent.select("change_id", "package_name", F.lit(rollback).alias("is_rollback")))
    return results[0].unionByName(results[1])


def change_summary_by_set(files: DataFrame, sources: DataFrame, year: int, root: str = "db") -> DataFrame:
    """Per change set: scripts and rollbacks written and missing, warnings, and whether to run.

    A script is missing if its package has no spec to make it from; ``missing_sources`` names it.
    """
    missing = missing_sources(files, sources, root).groupBy("change_id").agg(F.count(F.lit(1)).alias("missing"))
    written = (
        regenerate_scripts(files, sources, year, root)
        .groupBy("change_id")
        .agg(
            F.count(F.when(~F.col("is_rollback"), 1)).alias("scripts_written"),
            F.count(F.when(F.col("is_rollback"), 1)).alias("rollback_scripts_written"),
        )
    )
    seen = (
        classify_files(files, root)
        .groupBy("change_id")
        .agg(F.max("in_scripts").alias("has_scripts"), F.max("non_package_ddl").alias("warned"))
    )
    joined = seen.join(written, "change_id", "left").join(missing, "change_id", "left")
    scripts = F.coalesce("scripts_written", F.lit(0).cast("bigint"))
    rollbacks = F.coalesce("rollback_scripts_written", F.lit(0).cast("bigint"))
    return joined.select(
        "change_id",
        scripts.alias("scripts_written"),
        rollbacks.alias("rollback_scripts_written"),
        F.coalesce("missing", F.lit(0).cast("bigint")).alias("scripts_missing"),
        F.when(F.col("warned"), F.lit(1)).otherwise(F.lit(0)).alias("n_warnings"),
        (F.col("has_scripts") | (scripts + rollbacks > 0)).alias("should_run"),
    )
