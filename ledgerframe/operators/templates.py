"""Templates over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import templates as P


def render_named(templates: DataFrame, columns: list[str]) -> DataFrame:
    """Fill each named placeholder from the column of that name."""
    filled = P.render_named(F.col("template"), {c: F.col(c) for c in columns})
    return templates.withColumn("rendered", filled)


def render_positional(templates: DataFrame, columns: list[str]) -> DataFrame:
    args = F.array(*[F.col(c).cast("string") for c in columns])
    return templates.withColumn("rendered", P.render_positional(F.col("template"), args))


def extract_placeholders(templates: DataFrame, keep_braces: bool = False) -> DataFrame:
    found = P.extract_placeholders(F.col("template"), keep_braces)
    return templates.withColumn("placeholders", found)


def placeholder_usage(templates: DataFrame) -> DataFrame:
    """Templates per placeholder."""
    found = F.explode(P.extract_placeholders(F.col("template"))).alias("placeholder")
    return templates.select(found).groupBy("placeholder").agg(F.count(F.lit(1)).alias("n_templates"))
