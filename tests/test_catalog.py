from ledgerframe.operators import catalog as C
from ledgerframe.operators import changesets as X
from ledgerframe.operators import definitions as D
from ledgerframe.operators import impact as I


def objects(spark, rows):
    # every object's namesake of another kind and owner must not be seen
    full = [("APP", n, t, g, s) for n, t, g, s in rows] + [("ELSE", n, "VIEW", g, "INVALID") for n, _, g, _ in rows]
    return spark.createDataFrame(full, "owner string, object_name string, object_type string, generated string, status string")


def test_list_objects_patterns(spark):
    rows = [
        ("THRESHOLD", "TABLE", "N", "VALID"),
        ("ZEBRA", "TABLE", "N", "VALID"),
        ("PLAIN", "TABLE", "N", "VALID"),
        ("MADE", "TABLE", "Y", "VALID"),
        ("T$X", "TYPE", "N", "VALID"),
        ("TX", "TYPE BODY", "N", "VALID"),
        ("ZV", "VIEW", "Y", "VALID"),
        ("S", "SEQUENCE", "N", "VALID"),
    ]
    got = {r.object_name for r in C.list_objects(objects(spark, rows), "APP").collect()}
    # The underscore of the patterns is a wildcard, so THRESHOLD and ZEBRA are left out.
    assert got == {"PLAIN", "TX", "ZV"}


def test_lookups(spark):
    catalogue = objects(
        spark, [("A", "TABLE", "N", "VALID"), ("A", "VIEW", "N", "VALID"), ("B", "VIEW", "N", "VALID"), ("P", "PACKAGE", "N", "VALID")]
    )
    asked = spark.createDataFrame([("a", "TABLE"), ("p", "PACKAGE_SPEC"), ("p", "PACKAGE_BODY"), (" ", "TABLE"), ("a", "TABLE")], "object_name string, object_type string")
    got = {(r.object_name, r.object_type): r.found for r in C.object_exists(asked, catalogue, "APP").collect()}
    assert got == {("a", "TABLE"): True, ("p", "PACKAGE_SPEC"): True, ("p", "PACKAGE_BODY"): False, (" ", "TABLE"): False}
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "object_name string")
    assert {r.object_name: r.kind for r in C.object_kind(names, catalogue, "APP").collect()} == {"a": "ambiguous", "b": "VIEW", "c": "missing"}


def test_resolve(spark):
    catalogue = objects(spark, [("T1", "TABLE", "N", "VALID"), ("V1", "VIEW", "N", "VALID"), ("P", "PACKAGE", "N", "VALID")])
    indexes = spark.createDataFrame([("T1", "I1"), ("GONE", "I2")], "table_name string, index_name string")
    triggers = spark.createDataFrame([("TR1", "T1"), ("TR2", "T9")], "trigger_name string, table_name string")
    deps = spark.createDataFrame(
        [("TR1", "TRIGGER", "SEQUENCE", "S1"), ("TR2", "TRIGGER", "SEQUENCE", "S1")],
        "name string, type string, referenced_type string, referenced_name string",
    )
    changed = spark.createDataFrame(
        [("i1", "INDEX"), ("i2", "INDEX"), ("tr1", "TRIGGER"), ("s1", "SEQUENCE"), ("s2", "SEQUENCE"), ("v1", "COMMENT"),
         ("x", "COMMENT"), ("t1", "TABLE"), ("t2", "TABLE"), ("p", "PACKAGE_SPEC"), ("p", "PACKAGE_BODY")],
        "object_name string, object_type string",
    )
    got = {tuple(r) for r in C.resolve_changed_objects(changed, catalogue, indexes, triggers, deps, "APP").collect()}
    assert got == {
        ("t1", "TABLE", "regenerate"),
        ("i2", "INDEX", "unresolved"),
        ("t9", "TABLE", "regenerate"),
        ("s2", "SEQUENCE", "unresolved"),
        ("v1", "VIEW", "regenerate"),
        ("x", "COMMENT", "unresolved"),
        ("t2", "TABLE", "redundant"),
        ("p", "PACKAGE_SPEC", "regenerate"),
        ("p", "PACKAGE_BODY", "redundant"),
    }


def test_redundant_spec_takes_its_body_along(spark):
    asked = spark.createDataFrame([("Pkg", "PACKAGE_SPEC"), ("t", "TYPE_BODY"), ("i", "INDEX")], "object_name string, object_type string")
    got = {r.path for r in C.redundant_artifacts(asked, objects(spark, [("X", "TABLE", "N", "VALID")]), "APP").collect()}
    assert got == {"packages/pkg_spec.sql", "packages/pkg.sql", "types/t.sql"}


def test_invalid_objects_are_sorted(spark):
    rows = [("B", "VIEW", "N", "INVALID"), ("A", "VIEW", "N", "INVALID"), ("S", "SYNONYM", "N", "INVALID"), ("BIN$1", "TABLE", "N", "INVALID"), ("P", "PACKAGE BODY", "N", "INVALID")]
    frame = objects(spark, rows)
    assert [r.object_name for r in C.invalid_objects(frame, "APP").collect()] == ["P", "A", "B"]
    assert {r.statement for r in C.compile_statements(frame, "APP").collect()} == {
        "alter view A compile", "alter view B compile", "select 1 from S", "alter package P compile body",
    }


def test_index_order(spark):
    rows = [("T", n, u, "DISABLED", 1, "N") for n, u in [("IX10", "NONUNIQUE"), ("IX2", "NONUNIQUE"), ("UX", "UNIQUE"), ("7_A", "NONUNIQUE"), ("IX", "NONUNIQUE"), ("PK_T", "UNIQUE")]]
    frame = spark.createDataFrame(rows, "table_name string, index_name string, uniqueness string, compression string, prefix_length int, generated string")
    order = ["UX", "7_A", "IX2", "IX10", "IX"]
    assert [r.index_name for r in C.table_indexes(frame).collect()] == order
    ddl = frame.selectExpr("*", "concat(index_name, ' ;') as ddl")
    assert D.index_text(ddl, "APP").first().text == "\r\n" + "".join(f"\r\n{n};" for n in order)


def test_trigger_order_ignores_case(spark):
    frame = spark.createDataFrame([("b", "T"), ("A", "T"), ("Z_X", "T"), ("C", "T")], "trigger_name string, table_name string")
    assert [r.trigger_name for r in C.table_triggers(frame).collect()] == ["A", "b", "C"]


def test_comment_text(spark):
    tabs = spark.createDataFrame([("T", "it's"), ("U", None)], "table_name string, comments string")
    cols = spark.createDataFrame([("T", "C10", "ten"), ("T", "C2", "two\nlines"), ("U", "X", None)], "table_name string, column_name string, comments string")
    got = {r.table_name: r.text for r in D.table_comment_text(tabs, cols).collect()}
    assert got == {
        "T": "\r\n\r\nCOMMENT ON TABLE \"T\" IS 'it''s';"
        "\r\nCOMMENT ON COLUMN \"T\".\"C2\" IS 'twolines';\r\nCOMMENT ON COLUMN \"T\".\"C10\" IS 'ten';"
    }


def test_parse_change_script(spark):
    names = ["db/scripts/12_br_Pkg_A_rollback.sql", "db/scripts/12_br.sql", "db/scripts/12_rollback.sql", "db/scripts/x.txt"]
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "change_id bigint, pos bigint, filename string")
    got = [tuple(r)[3:] for r in X.parse_change_script(frame).orderBy("pos").collect()]
    assert got == [
        ("12", "br", "pkg_a", True, True),
        ("12", "br", "", False, True),
        (None, None, None, True, False),
        (None, None, None, False, False),
    ]


def test_last_file_wins(spark):
    names = ["db/scripts/1_a_p.sql", "db/scripts/007_b_P.sql", "db/scripts/x_c_p.sql", "db/ddl/packages/P_spec.sql", "db/scripts/3_c_q.sql"]
    frame = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "change_id bigint, pos bigint, filename string")
    got = X.change_candidates(frame, rollback=False).collect()
    assert [(r.package_name, r.number, r.branch, r.script_name) for r in got] == [("p", "7", "b", "007_b_P.sql")]


def test_change_summary(spark):
    rows = [(1, 0, "db/scripts/1_a_p.sql"), (1, 1, "db/ddl/packages/p.sql"), (1, 2, "db/ddl/views/v.sql"), (2, 0, "src/a.java")]
    files = spark.createDataFrame(rows, "change_id bigint, pos bigint, filename string")
    sources = spark.createDataFrame([("after", "p", "s 2003-2020", None)], "edition string, package_name string, spec string, body string")
    script = X.regenerate_scripts(files, sources, 2024).first()
    assert (script.file_name, script.text) == ("1_a_p.sql", "s 2003-2024/\n\n")
    got = {r.change_id: tuple(r)[1:] for r in X.change_summary_by_set(files, sources, 2024).collect()}
    assert got == {1: (1, 0, 0, 1, True), 2: (0, 0, 0, 0, False)}


def test_missing_sources(spark):
    rows = [(1, 0, "db/scripts/1_a_p.sql"), (1, 1, "db/scripts/1_a_p_rollback.sql"), (1, 2, "db/ddl/packages/p.sql")]
    files = spark.createDataFrame(rows, "change_id bigint, pos bigint, filename string")
    sources = spark.createDataFrame([("before", "p", "s", None), ("after", "p", None, "b")], "edition string, package_name string, spec string, body string")
    assert [tuple(r) for r in X.missing_sources(files, sources).collect()] == [(1, "p", False)]


def test_touch_counts_count_a_script_once(scripts):
    frame = scripts({"1_a.sql": "create table t (x); drop table t;", "2_b.sql": "alter table T add y;"})
    got = I.object_touch_counts(frame).collect()
    assert [tuple(r) for r in got] == [("t", "TABLE", 2)]


def test_ddl_candidates(scripts, registry):
    directory = scripts({"5_a.sql": "x", "500_b.sql": "new text", "600_c.sql": "same", "7_d_user.sql": "x", "8_e_rollback.sql": "x"})
    known = registry({"500_b.sql": "old text", "600_c.sql": "same", "5_a.sql": "other"})
    assert [r.name for r in I.ddl_candidates(directory, known).collect()] == ["5_a.sql", "500_b.sql"]
