"""Documents in parts are styled and compared as whole ones are."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import text as T
from ledgerframe.operators import definitions as D

PIECES = ['"', "'", "--", "/*", "*/", "\n", "-", "/", "*", "a", '"B"', "EDITIONABLE ", "NONEDITIONABLE ", "(CASE)", '"CASE",', " "]


def random_parts(seed, n):
    rng = random.Random(seed)
    made = []
    for doc in range(n):
        for part in range(rng.randint(1, 6)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
            made.append((f"d{doc}", part, text if part == 0 else "\r\n" + text))
    return made


def joined(rows):
    whole = {}
    for key, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        whole[key] = whole.get(key, "") + text
    return whole


def test_parts_are_styled_as_one_text(spark):
    """2,000 random documents of literals, comments and quotes, left open and closed at any place."""
    rows = random_parts(1, 2000)
    frame = spark.createDataFrame(rows, "object_name string, part bigint, text string")
    got = joined([tuple(r) for r in D.styled_parts(frame, ["object_name"]).collect()])
    whole = spark.createDataFrame(list(joined(rows).items()), "object_name string, text string")
    want = {r.object_name: r.text for r in whole.withColumn("text", T.code_style(F.col("text"))).collect()}
    assert got == want


@pytest.mark.parametrize("max_chars", [10**9, 200, 45, 1])
def test_table_documents_are_the_same_at_any_part_size(spark, max_chars):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = frame([("T1", "TABLE", 'CREATE TABLE "OWN"."T1" \n   (\t"A" NUMBER, "CASE" NUMBER)')], "object_name string, object_type string, ddl string")
    indexes = frame([], "table_name string, index_name string, generated string, uniqueness string, ddl string, compression string, prefix_length int, columns string")
    tabs = frame([("T1", 'it\'s "quoted" -- still')], "table_name string, comments string")
    # a literal that is left open in a trigger, closed in a later one, and a block comment likewise
    cols = frame([("T1", f"C{i}", f'c "{i}" {"x" * 40}') for i in range(9)], "table_name string, column_name string, comments string")
    sequences = frame([], "table_name string, sequence_name string, ddl string")
    bodies = ['say \'open "one" ', 'more "two" ', 'closed\' "three" ', '/* "four" ', '"five" */ "six" -- "seven"', '"eight" it\'s "nine"']
    triggers = frame([("T1", f"TR{i}", f'CREATE TRIGGER "OWN"."TR{i}" {b}\n/') for i, b in enumerate(bodies)], "table_name string, trigger_name string, ddl string")
    made = [D.table_documents(tables, indexes, tabs, cols, sequences, triggers, "OWN", max_chars=n) for n in (10**9, max_chars)]
    one, other = (joined([(r.object_name, r.part, r.text) for r in m.collect()]) for m in made)
    assert one == other and '"two"' in one["T1"] and '"five"' in one["T1"] and '"six"' not in one["T1"]


def regrouped(rng, text):
    """The text in other parts."""
    cuts = sorted({0, len(text), *[rng.randrange(len(text) + 1) for _ in range(rng.randrange(5))]})
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [""]


@pytest.mark.parametrize("stretch", [7, 1 << 20])
def test_drift_does_not_depend_on_parts(spark, stretch):
    rng = random.Random(4)
    texts = {f"p{i}": "".join(rng.choice(["a", "\r\n", "é", "bc", "\n", "x"]) for _ in range(rng.randrange(60))) for i in range(150)}
    changed = {k: t + "!" if i % 5 == 1 else t.replace("\r\n", "\n") if i % 5 == 2 else t for i, (k, t) in enumerate(texts.items()) if i % 5 != 3}
    changed["new"] = "n" * 30
    schema = "path string, part bigint, text string"
    sides = [
        spark.createDataFrame([(k, i, x) for k, t in side.items() for i, x in enumerate(regrouped(rng, t))], schema) for side in (texts, changed)
    ]
    fold = lambda t: t.replace("\r\n", "\n")
    want = {("new", "create")} | {(k, "delete") for k in texts if k not in changed}
    want |= {(k, "overwrite") for k in changed if k in texts and fold(changed[k]) != fold(texts[k])}
    assert {tuple(r) for r in D.corpus_drift(*sides, stretch=stretch).collect()} == want
    # against sides without parts, and itself
    whole = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert D.corpus_drift(whole, sides[0], stretch=stretch).count() == 0
    assert {tuple(r) for r in D.corpus_drift(whole, sides[1], stretch=stretch).collect()} == want


def test_drift_of_no_rows_and_null_texts(spark):
    frame = spark.createDataFrame([("a", 0, None), ("b", 0, ""), ("c", 0, ""), ("c", 1, "")], "path string, part bigint, text string")
    empty = frame.where("false")
    assert D.corpus_drift(empty, empty).collect() == []
    assert {tuple(r) for r in D.corpus_drift(empty, frame).collect()} == {("b", "create"), ("c", "create")}
    other = spark.createDataFrame([("b", ""), ("c", "")], "path string, text string")
    assert D.corpus_drift(other, frame).collect() == []
