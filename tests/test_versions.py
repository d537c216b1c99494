"""Versions of a bucketed registry, positions in a run, and scripts without a place in it."""

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import ordering as O
from ledgerframe.operators import reconcile as R
from ledgerframe.operators.registry import apply_changes
from ledgerframe.plans import runs as P
from ledgerframe.session import fresh_path
from ledgerframe.sources import bucketed as B

SCHEMA = "name string, file_hash string, text string, type int, status int"


def rows_of(frame):
    return sorted(map(tuple, frame.drop("bucket").collect()))


@pytest.fixture
def table(spark):
    root = fresh_path(spark, "bucketed")
    rows = [(f"{i}_s.sql", f"h{i}", f"text {i}", 0, 0) for i in range(300)]
    B.create(spark.createDataFrame(rows, SCHEMA), root, buckets=32)
    return root, rows


def test_a_commit_rewrites_the_buckets_of_its_names(spark, table):
    root, rows = table
    before = B.manifest_of(spark, root, 0)["buckets"]
    inserts = spark.createDataFrame([("900_n.sql", "hn", "new", 0, 0)], SCHEMA)
    updates = spark.createDataFrame([(f"{i}_s.sql", "u", f"changed {i}") for i in range(5)], "name string, file_hash string, text string")
    deletes = spark.createDataFrame([(f"{i}_s.sql",) for i in range(10, 14)], "name string")
    assert B.commit(spark, root, inserts, updates, deletes) == 1
    manifest = B.manifest_of(spark, root, 1)
    changed = [b for b, (a, c) in enumerate(zip(before, manifest["buckets"], strict=True)) if a != c]
    assert 0 < len(changed) == manifest["rewritten"] <= 10
    want = rows_of(apply_changes(spark.createDataFrame(rows, SCHEMA), inserts, updates, deletes))
    assert rows_of(B.read(spark, root)) == want and rows_of(B.read(spark, root, 0)) == sorted(rows)
    # files of other buckets are those of version 0
    files = {r.file for r in B.read(spark, root).select(F.input_file_name().alias("file")).distinct().collect()}
    files = {f for f in files if "version=0/" in f}
    assert files and not any(f"bucket={b}/" in f for f in files for b in changed)


def test_rows_that_stay_are_not_exchanged(spark, table):
    root, _ = table
    names = spark.createDataFrame([("3_s.sql",)], "name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = apply_changes(B.read(spark, root, only=[1, 2]).drop("bucket"), deletes=B.materialize(names, "n"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan = plan.index("text#")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    left = plan[scan : plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in left


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_commit_stay_in_place(spark, table, scripts, registry, monkeypatch):
    """Lists of names are short, the tables with texts are not: no table with texts is sorted for a join."""
    root, _ = table
    directory = scripts({f"{i}_s.sql": f"text {i} " * 30 for i in range(400)})
    known = registry({f"{i}_s.sql": f"text {i % 390} " * 30 for i in range(100, 395)})
    plans, kept = [], B.apply_changes

    def watched(*frames):
        plans.append(plan_of(kept(*frames)))
        return kept(*frames)

    monkeypatch.setattr(B, "apply_changes", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    # written texts are above the limit, written names below
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12k")
    try:
        fresh, changed = R.new_scripts(directory, known), R.updated_scripts(directory, known)
        assert {r.name for r in fresh.collect()} == {f"{i}_s.sql" for i in (*range(100), *range(395, 400))}
        assert {r.name for r in changed.collect()} == {f"{i}_s.sql" for i in range(390, 395)}
        for frame in (fresh, changed):
            assert "BroadcastHashJoin" in plan_of(frame) and "SortMergeJoin" not in plan_of(frame)
        wide = spark.range(300).selectExpr("concat(id, '_s.sql') as name", "'u' as file_hash", "concat_ws('', transform(sequence(1, 9), i -> sha2(cast(id * 9 + i as string), 512))) as text")
        B.commit(spark, root, updates=wide)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    anti = [line for line in plans[0].splitlines() if "LeftAnti" in line]
    assert anti and all("BroadcastHashJoin" in line for line in anti)
    assert B.read(spark, root).where("file_hash = 'u'").count() == 300 == B.read(spark, root).count()


def test_commits_on_one_version_conflict_and_unfinished_ones_are_unseen(spark, table, monkeypatch):
    root, rows = table
    one = spark.createDataFrame([("900_n.sql", "hn", "new", 0, 0)], SCHEMA)
    assert B.commit(spark, root, inserts=one, base=0) == 1
    with pytest.raises(B.ConflictError):
        B.commit(spark, root, inserts=one.withColumn("name", F.lit("901_n.sql")), base=0)
    assert len(rows_of(B.read(spark, root))) == 301

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched, pytest.raises(KeyboardInterrupt):
        patched.setattr(B, "_publish", stopped)
        B.commit(spark, root, deletes=one.select("name"))
    assert B.versions(spark, root) == [0, 1] and len(rows_of(B.read(spark, root))) == 301
    # a bucket that a commit empties stays readable
    assert B.commit(spark, root, deletes=spark.createDataFrame([(r[0],) for r in rows], "name string")) == 2
    assert [r[0] for r in rows_of(B.read(spark, root))] == ["900_n.sql"]
    assert B.commit(spark, root) == 2


def test_positions_follow_the_order(spark, scripts):
    made = [f"{n}_{c}.sql" for n in (1, 2, 10, 99, 100, 101, 1000) for c in "ba"] + [f"{n}_x_rollback.sql" for n in (5, 50, 500)]
    frame = scripts([*made, "9" * 39 + "_far.sql"]).select("name").repartition(5)
    forward = {r.name: r.position for r in O.commit_positions(frame).collect()}
    want = [r.name for r in O.commit_order(frame).collect() if r.order_number is not None]
    assert [n for n, _ in sorted(forward.items(), key=lambda x: x[1])] == want and sorted(forward.values()) == list(range(1, 15))
    back = sorted((r.position, r.name) for r in O.rollback_positions(frame).collect())
    assert [n for _, n in back] == [r.name for r in O.rollback_order(frame).collect()]


def test_scripts_out_of_range_do_not_run(spark, scripts, registry):
    far = "9" * 39
    directory = scripts({f"{far}_a.sql": "x", "100_a.sql": "y", f"{far}_b_rollback.sql": "z"})
    before = registry({f"{far}_old.sql": "o", f"{far}_old_rollback.sql": "r", "7_gone.sql": "g"})
    plan = {r.name: (r.action, r.position) for r in P.positioned(P.forward_plan(directory, before)).collect()}
    assert plan == {f"{far}_a.sql": ("quarantined", None), "100_a.sql": ("execute", 1), f"{far}_b_rollback.sql": ("quarantined", None)}
    assert {r.name for r in R.quarantined_scripts(directory).collect()} == {f"{far}_a.sql", f"{far}_b_rollback.sql"}
    undo = {r.name: (r.action, r.effect) for r in P.rollback_plan(directory, before, P.FORCE_EXECUTE, execute=True).collect()}
    assert undo == {f"{far}_old.sql": ("quarantined", "keep"), f"{far}_old_rollback.sql": ("quarantined", "keep"), "7_gone.sql": ("none", "delete")}
    after = {r.name for r in P.next_registry(directory, before, P.FORCE_EXECUTE, execute=True).collect()}
    assert after == {"100_a.sql", f"{far}_old.sql", f"{far}_old_rollback.sql"}
