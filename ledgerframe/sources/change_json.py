"""Change sets and change-set results held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGE_SET_SCHEMA = """
    head struct<ref: string>,
    commits array<struct<sha: string, commit: struct<message: string>>>,
    files array<struct<filename: string>>
"""
RESULT_SCHEMA = """
    {run_flag} boolean, scripts_written int, rollback_scripts_written int,
    warnings array<string>, error string
"""
MALFORMED = "malformed JSON"


def read_change_set_result(
    frame: DataFrame, json: str = "json", keep: tuple[str, ...] = (), run_flag: str = "should_run"
) -> DataFrame:
    """Result fields with their defaults: false, 0, 0, no warnings, no error.

    ``run_flag`` is the key under which a result says whether to run. A malformed result
    says so in ``error``; it never reads as a success.
    """
    r = F.from_json(json, RESULT_SCHEMA.format(run_flag=f"`{run_flag}`"))
    return frame.select(*keep, r.alias("r"), is_malformed(F.col(json)).alias("bad")).select(
        *keep,
        F.coalesce(F.col("r").getField(run_flag), F.lit(False)).alias("should_run"),
        F.coalesce("r.scripts_written", F.lit(0)).alias("scripts_written"),
        F.coalesce("r.rollback_scripts_written", F.lit(0)).alias("rollback_scripts_written"),
        F.coalesce("r.warnings", F.array().cast("array<string>")).alias("warnings"),
        F.when(F.col("bad"), F.lit(MALFORMED)).otherwise(F.col("r.error")).alias("error"),
    )


def is_malformed(json: Column) -> Column:
    """Is the text no JSON object? Null counts as malformed."""
    return F.coalesce(F.json_object_keys(json).isNull(), F.lit(True))


def rejected_documents(frame: DataFrame, json: str = "json") -> DataFrame:
    """The rows whose JSON can't be read, whole, with the reason."""
    return frame.where(is_malformed(F.col(json))).withColumn("reason", F.lit(MALFORMED))


def mistyped_fields(frame: DataFrame, json: str = "json") -> DataFrame:
    """(change_id, path, expected, found): fields of change sets that have another type than they should.

    A field that is absent or null is no fault, and what lies below a mistyped one isn't looked at. Types
    are those of variants: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN. Documents that can't
    be read at all are those of ``rejected_documents``. The readers below take a list with an element
    that is no object as absent, and a mistyped text as its JSON.
    """
    doc = F.when(~is_malformed(F.col(json)), F.try_parse_json(json))
    read = frame.select("change_id", doc.alias("doc"))

    def child(value: Column, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(value, path, kind)

    def fault(value: Column, path: Column, expected: str) -> Column:
        found = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        told = F.struct(path.alias("path"), F.lit(expected).alias("expected"), found.alias("found"))
        return F.when(~found.isin(expected, "VOID"), told)

    def items(field: str, *fields: tuple[str, str]) -> Column:
        """Faults of the elements of an array and of the fields below them."""

        def of_item(item: Column, i: Column) -> Column:
            at = F.format_string(f"$.{field}[%d]", i)
            below = [fault(child(item, f"$.{name}"), F.concat(at, F.lit(f".{name}")), kind) for name, kind in fields]
            return F.array(fault(item, at, "OBJECT"), *below)

        return F.flatten(F.transform(F.coalesce(child(F.col("doc"), f"$.{field}", "array<variant>"), F.array()), of_item))

    top = [("head", "OBJECT"), ("head.ref", "STRING"), ("commits", "ARRAY"), ("files", "ARRAY")]
    faults = F.concat(
        F.array(*(fault(child(F.col("doc"), f"$.{name}"), F.lit(f"$.{name}"), kind) for name, kind in top)),
        items("commits", ("sha", "STRING"), ("commit", "OBJECT"), ("commit.message", "STRING")),
        items("files", ("filename", "STRING")),
    )
    return read.select("change_id", F.inline(F.filter(faults, lambda f: f.isNotNull())))


def _parsed(frame: DataFrame, json: str) -> DataFrame:
    return frame.select("change_id", F.from_json(json, CHANGE_SET_SCHEMA).alias("c"))


def read_change_files(frame: DataFrame, json: str = "json") -> DataFrame:
    """(change_id, pos, filename) of all files; no page limit.

    Documents that can't be read are those of ``rejected_documents``.
    """
    rows = _parsed(frame, json).select("change_id", F.posexplode("c.files").alias("pos", "file"))
    return rows.select("change_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("file.filename", F.lit("")).alias("filename"))


def read_change_commits(frame: DataFrame, json: str = "json") -> DataFrame:
    """(change_id, sha, pos, message) of all commits; a missing message is empty."""
    rows = _parsed(frame, json).select("change_id", F.posexplode("c.commits").alias("pos", "c"))
    return rows.select(
        "change_id",
        F.col("c.sha").alias("sha"),
        F.col("pos").cast("bigint").alias("pos"),
        F.coalesce("c.commit.message", F.lit("")).alias("message"),
    )


def read_change_heads(frame: DataFrame, json: str = "json") -> DataFrame:
    """(change_id, head_branch) of every document; the branch of one that can't be read is null."""
    return _parsed(frame, json).select("change_id", F.col("c.head.ref").alias("head_branch"))
