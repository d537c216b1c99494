"""Hot keys: the split paths give the same rows, and the plan is the one intended."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import catalog as C
from ledgerframe.operators import changesets as X
from ledgerframe.operators import definitions as D
from ledgerframe.operators import ordering as O
from ledgerframe.operators import skew
from ledgerframe.operators.skew import join_counted, ordered_text
from ledgerframe.plans import runs


def log_rows(seed=1):
    """One run holds a third of all steps."""
    rng = random.Random(seed)
    rows = []
    for step in range(900):
        run = 0 if step % 3 == 0 else rng.randrange(1, 40)
        rows.append((run, step, step // 4, int(rng.random() < 0.03)))
    return rows


@pytest.fixture()
def log(spark):
    frame = spark.createDataFrame(log_rows(), "run_id bigint, step_id bigint, t bigint, exit_code int")
    return frame.selectExpr(
        "run_id", "step_id", "cast(timestamp_seconds(t) as timestamp_ntz) as ts", "exit_code", "step_id / 7.0D as seconds"
    )


def replay(rows):
    kept, stopped = [], set()
    for run, step, t, code in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if run not in stopped:
            kept.append((run, step, 2 if code else 0))
        if code:
            stopped.add(run)
    return sorted(kept)


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_run_until_failure_with_a_hot_run(log, hot_rows):
    got = O.run_until_failure(log, hot_rows=hot_rows).collect()
    assert sorted((r.run_id, r.step_id, r.status) for r in got) == replay(log_rows())


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_run_summary_with_a_hot_run(log, hot_rows):
    want = {}
    for run, _, _ in replay(log_rows()):
        want[run] = want.get(run, 0) + 1
    got = O.run_summary(log, hot_rows=hot_rows).collect()
    assert {r.run_id: r.steps_recorded for r in got} == want
    assert sum(r.steps_recorded + r.steps_remaining for r in got) == 900


def test_examples_of_replay(spark):
    rows = [(1, i, i, c) for i, c in enumerate([0, 0, 1, 0])]
    frame = spark.createDataFrame(rows, "run_id bigint, step_id bigint, t bigint, exit_code int").selectExpr(
        "run_id", "step_id", "cast(timestamp_seconds(t) as timestamp_ntz) as ts", "exit_code", "1.5D as seconds"
    )
    got = O.run_until_failure(frame).orderBy("step_id").collect()
    assert [(r.step_id, r.status) for r in got] == [(0, 0), (1, 0), (2, 2)]
    assert O.run_until_failure(frame, ignore_errors=True).count() == 4
    summary = O.run_summary(frame).first()
    assert (summary.first_failed_step, summary.steps_remaining, summary.elapsed) == (2, 1, "00:00:04.500")
    assert O.failed_runs(frame).first().first_failed_step == 2


def test_join_counted_left_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(i % 5, i) for i in range(50)], "k int, v int")
    right = spark.createDataFrame([(0, 10), (1, 10), (2, 10)], "k int, n_rows bigint")
    for hot in (5, 100):
        got = join_counted(left, right, ["k"], "left", hot_rows=hot)
        assert got.count() == 50
        assert got.where("n_rows is null").count() == 20


def test_hot_rows_do_not_reach_the_shuffle(log):
    """The hot run is joined by broadcast; only the others go through the exchange."""
    text = O.run_until_failure(log, hot_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("strategy=broadcast") == 2 and "LeftAnti" in text


def fragments_of(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        parent = 0 if i % 3 == 0 else rng.randrange(1, 30)
        rows.append((parent, rng.choice(["base", "indexes", "triggers", "other"]), i, f"<{parent}.{i}>"))
    rng.shuffle(rows)
    return rows


def spelled(rows):
    rank = {k: i for i, k in enumerate(D.KIND_ORDER)}
    out = {}
    for parent, kind, ord_, text in sorted(rows, key=lambda r: (r[0], rank.get(r[1], 99), r[1], r[2])):
        out[parent] = out.get(parent, "") + text
    return out


@pytest.mark.parametrize("max_chars,part_rows", [(10**9, 1 << 16), (200, 1 << 16), (200, 8), (20, 1), (1, 4)])
def test_documents_are_whole_at_any_part_size(spark, max_chars, part_rows):
    rows = fragments_of()
    frame = spark.createDataFrame(rows, "parent_id bigint, kind string, ord bigint, text string")
    got = D.assemble_documents(frame, max_chars=max_chars, part_rows=part_rows).collect()
    joined = {}
    for r in sorted(got, key=lambda r: (r.parent_id, r.part)):
        joined[r.parent_id] = joined.get(r.parent_id, "") + r.text
    assert joined == spelled(rows)
    longest = max(len(t) for *_, t in rows)
    if max_chars == 200:
        assert len(got) > len(joined)
        assert max(len(r.text) for r in got) <= max_chars + longest
        assert all(len(r.text) <= part_rows * longest for r in got)


def test_documents_that_open_with_another_kind_are_left_out(spark):
    rows = [("a", 0, "A"), ("a", 1, "B"), ("b", 1, "C"), ("c", 0, "D" * 50), ("d", 1, "E" * 50), ("c", 1, None)]
    frame = spark.createDataFrame(rows, "k string, o int, text string")
    for max_chars in (10**9, 10):
        got = {}
        for r in ordered_text(frame, ["k"], [F.col("o")], max_chars=max_chars, opens_with=0).orderBy("k", "part").collect():
            got[r.k] = got.get(r.k, "") + r.text
        assert got == {"a": "AB", "c": "D" * 50}


def skewed_join_count(spark, build):
    """Run with tiny skew thresholds; how many joins did adaptive execution split?"""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        # Small stages would be coalesced to one mapper, which leaves nothing to split.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = build()
        frame.write.format("noop").mode("overwrite").save()
        rows = frame.collect()
        return frame._jdf.queryExecution().executedPlan().toString().count("skew=true"), rows
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_trigger_is_split_by_adaptive_execution(spark):
    deps = spark.range(0, 6000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'TR_HOT', concat('TR_', id)) as name",
        "'TRIGGER' as type",
        "'SEQUENCE' as referenced_type",
        "concat('SEQ_', id) as referenced_name",
    )
    triggers = spark.range(0, 6000, 1, 4).selectExpr(
        "if(id = 0, 'TR_HOT', concat('TR_', id)) as trigger_name", "concat('T', id % 50) as table_name"
    )
    splits, rows = skewed_join_count(spark, lambda: C.table_sequences(deps, triggers))
    assert splits >= 1
    want = {("T0" if i % 3 == 0 else f"T{i % 50}", f"SEQ_{i}") for i in range(6000)}
    assert {(r.table_name, r.sequence_name) for r in rows} == want


def test_hot_package_is_split_by_adaptive_execution(spark):
    kinds = "if(id % 3 = 0, 'hot', concat('p', id))"
    files = spark.range(0, 4000, 1, 8).selectExpr(
        "id as change_id",
        "0L as pos",
        f"explode(array(concat('db/scripts/', id, '_br_', {kinds}, '.sql'), concat('db/ddl/packages/', {kinds}, '.sql'))) as filename",
    )
    sources = spark.range(0, 4000, 1, 4).selectExpr(
        "'after' as edition", "if(id = 0, 'hot', concat('p', id)) as package_name", "concat('spec', id, '/') as spec", "'b' as body"
    )
    splits, rows = skewed_join_count(spark, lambda: X.regenerate_scripts(files, sources, 2024))
    assert splits >= 1
    assert len(rows) == 4000 and len({r.file_name for r in rows}) == 4000


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_parent_by_sequence_with_many_tables(spark, hot_rows):
    deps = spark.range(90).selectExpr(
        "concat('TR_', id) as name", "'TRIGGER' as type", "'SEQUENCE' as referenced_type", "if(id < 60, 'S', concat('S', id)) as referenced_name"
    )
    triggers = spark.range(90).selectExpr("concat('TR_', id) as trigger_name", "concat('T', id) as table_name")
    asked = spark.createDataFrame([("s",), ("s60",), ("none",), ("s",)], "object_name string")
    got = C.parent_by_sequence(asked, deps, triggers, hot_rows=hot_rows).collect()
    assert sum(r.object_name == "s" for r in got) == 60 and all(r.n_tables == 60 for r in got if r.object_name == "s")
    assert [(r.table_name, r.n_tables) for r in got if r.object_name == "s60"] == [("T60", 1)]
    assert [(r.table_name, r.n_tables) for r in got if r.object_name == "none"] == [(None, 0)]


def test_joins_with_texts_have_tasks_by_their_bytes(spark, scripts, registry, monkeypatch):
    """At 100 bytes a task 40 texts of 100 bytes make 40 tasks or more, not Spark's four."""
    directory = scripts({f"{i}_s.sql": "x" * 100 for i in range(40)})
    known = registry({f"{i}_s.sql": "x" * 100 for i in range(1, 41)})
    want = sorted(map(str, runs.next_registry(directory, known).collect()))
    few = skew.dealt_by_bytes
    monkeypatch.setattr(runs, "dealt_by_bytes", lambda slim, keys, size: few(slim, keys, size, 100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        after = runs.next_registry(directory, known)
        plan = after._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, after.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want and len(got) == 40
    texts = [line for line in plan.splitlines() if "hashpartitioning(name" in line and ", 40)" in line]
    assert len(texts) == 4  # both sides of the join with old rows and of that with new ones
