import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import templates as P
from ledgerframe.functions import text as T


def apply(spark, rule, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.select("i", rule(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def found(spark, text):
    rows = apply(spark, T.changed_object_array, [text])[0]
    return [(r.object_name, r.object_type) for r in rows]


def test_normalize(spark):
    text = 'A -- gone\r\nB/* x\n y */C\n\n\n"D"   e\tf -- stays'
    assert apply(spark, T.normalize_script, [text]) == ["a bc d e\tf -- stays"]


def test_line_comment_with_a_lone_carriage_return_is_no_comment(spark):
    assert apply(spark, T.normalize_script, ["-- a\rb\nc"]) == ["-- a\rb c"]


CHANGES = [
    ("create table owner.t (id int); drop table if exists q;", [("owner", "TABLE"), ("if", "TABLE")]),
    ("CREATE OR REPLACE PACKAGE BODY p AS", [("p", "PACKAGE_BODY")]),
    ("create or replace package p as", [("p", "PACKAGE_SPEC")]),
    ("replace force view v as", [("v", "VIEW")]),
    ("comment on column t.c is 'x'", [("t", "COMMENT")]),
    ("create unique index i on t(a)", [("i", "INDEX")]),
    ("create bitmap index i on t(a)", []),
    ("drop type body b; alter type s", [("b", "TYPE_BODY"), ("s", "TYPE_SPEC")]),
    ('create table "Q$x"', [("q", "TABLE")]),
    ("-- create table hidden\nselect 1", []),
    ("'--' create table lost\n", []),
]


@pytest.mark.parametrize("text,expected", CHANGES)
def test_changed_objects(spark, text, expected):
    assert found(spark, text) == expected


def test_changed_objects_of_made_statements(spark):
    """Every statement names its object and kind; notes and comments name none."""
    rng = random.Random(5)
    phrases = [(kind, p) for kind, ps in T.CHANGE_PHRASES.items() for p in ps]
    texts, want = [], []
    for _ in range(400):
        made = [(*rng.choice(phrases), f"obj{rng.randrange(9)}") for _ in range(rng.randrange(6))]
        gap = lambda: rng.choice([" ", "  ", "\n"])
        tail = lambda: rng.choice(["\n", " -- note\n", " /* drop table no */ ", "\r\n"])
        texts.append("".join(f"{phrase.upper()}{gap()}{name} (x);{tail()}" for _, phrase, name in made))
        want.append(sorted((name, kind) for kind, _, name in made))
    got = apply(spark, T.changed_object_array, texts)
    assert [sorted((r.object_name, r.object_type) for r in row) for row in got] == want


def test_is_package_script(spark):
    texts = ["create package p", "drop package body p", "create table t", "", None]
    assert apply(spark, T.is_package_script, texts) == [True, True, False, False, False]


def test_unquote(spark):
    texts = ["SELECT \"A\", 'x\"y' -- \"q\"", '/* "k" */ "B"', 'x(CASE) "UPPERCASE", "CASE",']
    assert apply(spark, T.unquote_identifiers, texts) == [
        "SELECT A, 'x\"y' -- \"q\"",
        '/* "k" */ B',
        'x("CASE") UPPERCASE, "CASE",',
    ]


def test_strip_schema_is_literal(spark):
    rule = lambda c: T.strip_schema(c, "a.p")
    assert apply(spark, rule, ['"A.P"."T" "AXP"."T"']) == ['"T" "AXP"."T"']


def test_number_aware_key(spark):
    frame = spark.createDataFrame([(n,) for n in ["FK10", "FK2", "fk3", "A10", "A2", "A1B"]], "n string")
    got = [r.n for r in frame.orderBy(T.number_aware_key(F.col("n"))).collect()]
    assert got == ["A2", "A10", "A1B", "FK2", "fk3", "FK10"]
    long = spark.createDataFrame([("A" + "9" * 60,), ("A1" + "0" * 60,)], "n string")
    assert long.orderBy(T.number_aware_key(F.col("n"))).first().n == "A" + "9" * 60


def test_canonical_package(spark):
    rule = lambda c: T.canonical_package(c, "app")
    got = apply(spark, rule, ['\n  CREATE "APP"."P" AS\nend; \n\n  /\n', "x/", "x\n  y"])
    assert got == ['CREATE "P" AS\r\nend;\r\n/', "x/", "x\r\n  y"]


TABLE = (
    '\n  CREATE TABLE "APP"."T" \n   (\t"ID" NUMBER, \n\t"E" VARCHAR2(9) DEFAULT \'a@b\', \n'
    '\t CONSTRAINT "FK10" FOREIGN KEY ("A")\n\t  REFERENCES "APP"."P" ENABLE, \n'
    '\t CHECK (x > 0) ENABLE, \n\t CONSTRAINT "FK2" FOREIGN KEY ("B")\n\t  REFERENCES "APP"."Q" ENABLE, \n'
    '\t CONSTRAINT "PK_T" PRIMARY KEY ("ID")\n  USING INDEX  ENABLE\n   ) ;'
)


def test_canonical_table(spark):
    got = apply(spark, lambda c: T.canonical_table(c, "APP"), [TABLE])[0]
    lines = got.replace("\r\n", "\n").split("\n")
    assert lines == [
        'CREATE TABLE "T" (',
        '    "ID" NUMBER, ',
        "    \"E\" VARCHAR2(9) DEFAULT 'a@b', ",
        '     CONSTRAINT "PK_T" PRIMARY KEY ("ID"),',
        '     CONSTRAINT "FK2" FOREIGN KEY ("B") REFERENCES "Q" ENABLE,',
        '     CONSTRAINT "FK10" FOREIGN KEY ("A") REFERENCES "P" ENABLE,',
        "     CHECK (x > 0) ENABLE",
        ");",
    ]


def test_sort_constraints_without_a_block(spark):
    texts = ["create table t (a int)", "x CONSTRAINT y", "CONSTRAINT a CHECK (b)\n)"]
    assert apply(spark, T.sort_constraints, texts) == texts


def test_index_statement(spark):
    frame = spark.createDataFrame(
        [('\n CREATE INDEX "APP"."I" ON "T" ("C") \n  ;', c, 2) for c in ("ENABLED", "DISABLED")],
        "ddl string, compression string, n int",
    )
    got = [r[0] for r in frame.select(T.index_statement(F.col("ddl"), F.col("compression"), F.col("n"), "APP")).collect()]
    assert got == ['CREATE INDEX "I" ON "T" ("C") COMPRESS 2;', 'CREATE INDEX "I" ON "T" ("C");']


def test_sequence_and_trigger_statements(spark):
    seq = apply(spark, lambda c: T.sequence_statement(c, "APP"), ['\n CREATE SEQUENCE  "APP"."S"  MINVALUE 1 ;', "S 1 ;"])
    assert seq == ['\r\n\r\nCREATE SEQUENCE  "S";', "\r\n\r\nS 1;"]
    trg = apply(
        spark,
        lambda c: T.trigger_statement(c, "APP"),
        ['CREATE TRIGGER "APP"."R"\nbegin\nend;\n  /\nALTER TRIGGER "APP"."R" ENABLE;'],
    )
    assert trg == ['\r\nCREATE TRIGGER "R"\r\nbegin\r\nend;\r\n/\r\n']


def test_compose_package(spark):
    frame = spark.createDataFrame(
        [("s\n/  \n", "b\n/\n  "), ("s;\n\n", "b; "), ("s", None), (None, "b")], "spec string, body string"
    )
    got = [r[0] for r in frame.select(T.compose_package(F.col("spec"), F.col("body"))).collect()]
    assert got == ["s\n/\n\nb\n/\n", "s;/\n\nb;\n", "s/\n\n", None]


def test_year_range(spark):
    assert apply(spark, lambda c: T.rewrite_year_range(c, 2024), ["2003-2019 2003-19"]) == ["2003-2024 2003-19"]


def test_render_named(spark):
    frame = spark.createDataFrame(
        [("from {link}", "any {x} message"), ("{x}{link}{", "v"), ("  ", "v"), ("{link", "v")], "t string, link string"
    )
    got = [r[0] for r in frame.select(P.render_named(F.col("t"), {"link": F.col("link")})).collect()]
    assert got == ["from any {x} message", "{x}v{", "  ", "{link"]
    assert frame.select(P.render_named(F.col("t"), {})).first()[0] == "from {link}"


def test_render_positional(spark):
    frame = spark.createDataFrame([("x{} and y = {}, z{}", [4, 9])], "t string, a array<int>")
    assert frame.select(P.render_positional(F.col("t"), F.col("a"))).first()[0] == "x4 and y = 9, z{}"


def test_extract_placeholders(spark):
    texts = ["{rowCount} rows of {tableName}: {state}", '{a} {"b"} {x{yy} {zz} {zz}', None]
    assert apply(spark, P.extract_placeholders, texts) == [["rowCount", "tableName", "state"], ["yy", "zz"], []]
    braces = apply(spark, lambda c: P.extract_placeholders(c, True), texts[:1])
    assert braces == [["{rowCount}", "{tableName}", "{state}"]]


def test_comments_keep_their_lines_but_on_columns_of_tables(spark):
    frame = spark.createDataFrame([("T", "C", "a\nb'c")], "t string, c string, x string")
    t, c, x = (F.col(n) for n in "tcx")
    got = frame.select(T.comment_statement(t, None, x), T.comment_statement(t, c, x), T.comment_statement(t, c, x, one_line=True)).first()
    assert list(got) == [
        "COMMENT ON TABLE \"T\" IS 'a\nb''c';",
        "COMMENT ON COLUMN \"T\".\"C\" IS 'a\nb''c';",
        "COMMENT ON COLUMN \"T\".\"C\" IS 'ab''c';",
    ]
