"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language on a sample of about ``SAMPLE_DOCS`` labelled texts. Languages
share it evenly: one with fewer texts than its share is learned from all of them, the others from
those whose hash, of id and text, falls below the language's threshold. So no language is left out
because others are frequent; how frequent each is, in all rows, is its prior. The log-probability matrix (languages x buckets, at most
``MATRIX_CELLS`` cells: more languages take fewer buckets) is broadcast, and batches of texts are
scored in numpy: the rows of a text's n-grams are gathered and summed.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text
when nothing was learned. Case and repeated rows don't matter; whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import byte_batches

SAMPLE_DOCS = 20_000
MATRIX_CELLS = 1 << 22
BUCKETS = 1 << 17
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Bytes of text scored at once; the n-grams of a byte take about a hundred.
CHUNK = 1 << 18
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: buckets + 1 rows; the last is for places outside of texts
    matrix: np.ndarray
    priors: np.ndarray


def grams(rows: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (one line per order) and the places where the rows start.

    Two ends stand after every row, so that no n-gram reaches the next row.
    """
    chars = np.frombuffer("".join(row.lower() + "\0\0" for row in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(row.lower()) + 2 for row in rows), np.int64, len(rows))
    starts = np.cumsum(lengths) - lengths
    outside = np.zeros(len(chars), bool)
    outside[starts + lengths - 1] = outside[starts + lengths - 2] = True
    found = np.empty((len(ORDERS), len(chars)), np.int64)
    code = np.zeros(len(chars), np.uint32)
    for i, order in enumerate(ORDERS):
        code[: len(chars) - order + 1] += chars[order - 1 :] * _FACTORS[i]
        mixed = (code ^ np.uint32(order)) * np.uint32(0x27D4EB2F)
        found[i] = (mixed ^ (mixed >> np.uint32(15))) & np.uint32(buckets - 1)
        found[i][outside] = buckets
    return found, starts


def _counted(sample: DataFrame, buckets: int) -> DataFrame:
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in byte_batches(batches, CHUNK):
            frame = batch.to_pandas()
            for lang, rows in frame.groupby("lang")["text"]:
                found, _ = grams(list(rows), buckets)
                total = totals.setdefault(lang, np.zeros(buckets + 1, np.int64))
                total += np.bincount(found.ravel(), minlength=buckets + 1)
        for lang, total in totals.items():
            at = np.flatnonzero(total[:buckets])
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]}), preserve_index=False)

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def even_share(counts: list[int], total: int) -> float:
    """The bound under which counts add up to ``total`` if larger ones are cut to it."""
    left = total
    for i, count in enumerate(sorted(counts)):
        share = left / (len(counts) - i)
        if count > share:
            return share
        left -= count
    return float(max(counts))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from the columns text and lang, of rows that have both; None without such rows."""
    key = [c for c in ("doc_id",) if c in labelled.columns]
    labelled = labelled.filter("text is not null and lang is not null").select("text", "lang", *key)
    # one row per language
    documents = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not documents:
        return None
    sample = labelled
    if sum(documents.values()) > sample_docs:
        share = even_share(list(documents.values()), sample_docs)
        bounds = [(lang, min(int(share / n * 2**63), 2**63 - 1)) for lang, n in documents.items()]
        bounds = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long"))
        place = F.xxhash64(*key, "text").bitwiseAND(F.lit(2**63 - 1))
        sample = labelled.join(bounds, "lang").filter(place <= F.col("bound"))
    languages = sorted(documents)
    buckets = BUCKETS
    while buckets * len(languages) > MATRIX_CELLS:
        buckets //= 2
    rows = _counted(sample, buckets).toPandas()
    counts = np.zeros((buckets, len(languages)))
    counts[rows["bucket"], np.searchsorted(languages, rows["lang"])] = rows["n"]
    odds = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets))
    matrix = np.vstack([odds, np.zeros(len(languages))]).astype(np.float32)
    sizes = np.array([documents[lang] for lang in languages], float)
    return Model(languages, matrix, np.log(sizes / sizes.sum()))


def scores(model: Model, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its posterior probability, per row."""
    found, starts = grams(rows, len(model.matrix) - 1)
    total = np.tile(model.priors, (len(rows), 1))
    for line in found:
        total += np.add.reduceat(model.matrix[line], starts, axis=0, dtype=np.float64)
    best = total.argmax(axis=1)
    return best, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)


def predicted(docs: DataFrame, model: Model | None, *more: str) -> DataFrame:
    """doc_id, lang_pred and score of every text, with further columns of ``docs`` by name.

    Only texts go to the Python workers; other columns stay in the rows.
    """
    named = ["doc_id", *(c for c in more if c != "doc_id")]
    if model is None:
        return docs.select(*named, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def told(text: pa.Array) -> pa.Array:
        lang, score = [], []
        for batch in byte_batches([pa.RecordBatch.from_arrays([text], names=["text"])], CHUNK):
            best, sure = scores(shared.value, batch.column(0).to_pylist())
            lang += [shared.value.languages[i] for i in best.tolist()]
            score += sure.tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*named, told(F.coalesce("text", F.lit(""))).alias("_told"), known.alias("_known"))
    return rows.select(
        *named,
        F.when(F.col("_known"), F.col("_told.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_known"), F.col("_told.score")).otherwise(0.0).alias("score"),
    )
