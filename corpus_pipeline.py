"""From documents to packed training sequences: five stages, each on what the one before kept.

Stages carry the whole row of a document along as one value, so columns of any name survive.
Every stage but the last returns the columns of ``documents``. Rows that repeat are rows of their
own until near-dedup, which keeps one row of each class, whether ids repeat or not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.llm import language_id, near_dedup, packing, quality_rules, suffix_dedup
from ledgerframe.session import materialize

#: Below this posterior probability a language is no answer.
LANGUAGE_SCORE = 0.5
END_ID = 1


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, and the row as ``_row``."""
    return docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_row"))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language.

    Where no document names its language nothing can be learned, and only those without a letter go.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = language_id.predicted(_carried(docs), model, "_row")
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)
    return told.filter(known).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base or whose posterior quality is below the threshold.

    Texts are counted twice, for the weights and for the verdicts: a table of votes that carries
    the documents along would take their size in the shared folder.
    """
    judged = quality_rules.counted(_carried(docs), "_row").withColumns(quality_rules.votes())
    good = quality_rules.posterior(quality_rules.fit(judged)) >= quality_rules.THRESHOLD
    return judged.filter(~quality_rules.base_failed() & good).select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates."""
    classes = near_dedup.near_classes(_carried(docs), "_row")
    return classes.filter(F.col("row") == F.col("class")).select("_row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that earlier documents have; characters are cut whole or not at all."""
    cut = suffix_dedup.without_repeats(_carried(docs), "_row", whole_chars=True)
    text = F.when(F.col("_row.text").isNotNull(), F.col("bytes").cast("string"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(row.alias("_row")).select("_row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens, with the crc of their ids."""
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language ID", languages),
    ("quality rules", quality),
    ("near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("packing", sequences),
]

#: SQL can express neither the trained stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
