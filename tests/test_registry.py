import random

import pytest

from ledgerframe.functions import names as N
from ledgerframe.operators import reconcile as R
from ledgerframe.operators import registry as G
from ledgerframe.plans import runs as P


def names(frame):
    return {r.name for r in frame.collect()}


DIRECTORY = {
    "1_a.sql": "same",
    "2_b.sql": "edited",
    "500_new.sql": "n",
    "500_new_rollback.sql": "n",
    "7_keep_rollback.sql": "k",
    "dev_x.sql": "d",
}
REGISTRY = {
    "1_a.sql": "same",
    "2_b.sql": "old",
    "300_gone.sql": "g",
    "300_gone_rollback.sql": "g",
    "40_gone.sql": "g",
    "40_gone_rollback.sql": "g",
    "600_alone.sql": "a",
    "7_keep.sql": "k",
}


@pytest.fixture()
def sides(scripts, registry):
    return scripts(DIRECTORY), registry(REGISTRY)


def test_reconcile(sides):
    got = {r.name: r.change for r in R.reconcile(*sides).collect()}
    assert got == {
        "1_a.sql": "unchanged",
        "2_b.sql": "updated",
        "500_new.sql": "new",
        "500_new_rollback.sql": "new",
        "7_keep_rollback.sql": "new",
        "300_gone.sql": "deleted",
        "300_gone_rollback.sql": "deleted",
        "40_gone.sql": "deleted",
        "40_gone_rollback.sql": "deleted",
        "600_alone.sql": "deleted",
        "7_keep.sql": "deleted",
    }


def test_parts_agree_with_reconcile(sides):
    parts = {
        "new": R.new_scripts(*sides),
        "deleted": R.deleted_scripts(*sides),
        "updated": R.updated_scripts(*sides),
        "unchanged": R.unchanged_scripts(*sides),
    }
    whole = R.reconcile(*sides).collect()
    for change, frame in parts.items():
        assert names(frame) == {r.name for r in whole if r.change == change}
    updated = R.updated_scripts(*sides).first()
    assert (updated.text, updated.script_id) == ("edited", 2)


def test_reconcile_with_itself(scripts, registry):
    items = {f"{i}_s.sql": str(i) for i in range(20)}
    assert {r.change for r in R.reconcile(scripts(items), registry(items)).collect()} == {"unchanged"}


def test_pairs_and_orphans(sides):
    assert names(R.paired_rollbacks(*sides)) == {"300_gone_rollback.sql", "40_gone_rollback.sql"}
    assert names(R.unpaired_deletions(*sides)) == {"600_alone.sql", "7_keep.sql"}
    assert names(R.orphaned_rollbacks(*sides)) == {"7_keep.sql"}
    with pytest.raises(ValueError):
        R.orphaned_rollbacks(*sides, raise_on=True)


def test_read_registry_keeps_the_highest_id(spark):
    rows = [(1, "a", "x"), (3, "a", "z"), (2, "a", "y"), (9, "b", "w")]
    got = G.read_registry(spark.createDataFrame(rows, "script_id bigint, name string, text string"))
    assert {(r.name, r.script_id, r.text) for r in got.collect()} == {("a", 3, "z"), ("b", 9, "w")}


def test_repeated_names_count_once(scripts, spark):
    rows = [(i, "5_hot.sql", f"t{i}", 0, 0) for i in range(30)] + [(99, "6_b.sql", "x", 0, 0)]
    log = spark.createDataFrame(rows, "script_id bigint, name string, text string, type int, status int")
    directory = scripts({"6_b.sql": "x", "7_c.sql": "y"})
    assert [(r.name, r.script_id) for r in R.deleted_scripts(directory, log).collect()] == [("5_hot.sql", 29)]
    assert names(R.new_scripts(directory, log)) == {"7_c.sql"}
    assert {r.name: r.change for r in R.reconcile(directory, log).collect()} == {
        "5_hot.sql": "deleted", "6_b.sql": "unchanged", "7_c.sql": "new",
    }
    assert names(P.next_registry(directory, log, P.SKIP, True)) == {"6_b.sql", "7_c.sql"}


def test_read_registry_combines_before_the_shuffle(spark):
    rows = spark.range(0, 20000, 1, 4).selectExpr(
        "id as script_id", "if(id % 3 = 0, 'hot', concat('n', id)) as name", "'t' as text"
    )
    plan = G.read_registry(rows)._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange")
    assert "partial_max" in plan[shuffle:]
    assert G.read_registry(rows).where("name = 'hot'").first().script_id == 19998


def test_semi_filter_with_no_keys(spark, registry):
    empty = spark.createDataFrame([], "name string")
    assert G.semi_filter(registry(REGISTRY), empty, ["name"]).count() == 0
    assert G.semi_filter(registry(REGISTRY), empty, ["name"], keep=False).count() == len(REGISTRY)


def final(frame):
    return {r.name: (r.text, r.status) for r in frame.collect()}


def test_forced_run_twice(scripts, registry, spark):
    directory, before = scripts(DIRECTORY), registry(REGISTRY)
    once = P.next_registry(directory, before, P.FORCE_EXECUTE, execute=True)
    got = final(once)
    # Unpaired deletions outlive a run that had rollbacks to run.
    assert set(got) == {n for n in DIRECTORY if n != "dev_x.sql"} | {"600_alone.sql", "7_keep.sql"}
    assert got["2_b.sql"] == ("edited", 0)
    again = spark.createDataFrame(
        [(i, r.name, r.text, r.type, r.status) for i, r in enumerate(once.collect())],
        "script_id bigint, name string, text string, type int, status int",
    )
    twice = final(P.next_registry(directory, again, P.FORCE_EXECUTE, execute=True))
    assert set(twice) == {n for n in DIRECTORY if n != "dev_x.sql"}


def test_rollback_failure_stops_the_run(scripts, registry, spark):
    outcomes = spark.createDataFrame([("40_gone_rollback.sql", 1)], "name string, exit_code int")
    sides = scripts(DIRECTORY), registry(REGISTRY)
    plan = {r.name: (r.action, r.effect) for r in P.rollback_plan(*sides, P.FORCE_EXECUTE, True, outcomes=outcomes).collect()}
    assert plan["40_gone_rollback.sql"] == ("run", "delete")
    assert plan["40_gone.sql"] == ("undone", "delete")
    assert plan["300_gone_rollback.sql"] == ("not_reached", "keep")
    assert plan["600_alone.sql"] == ("none", "keep")
    got = final(P.next_registry(*sides, P.FORCE_EXECUTE, True, outcomes=outcomes))
    assert "500_new.sql" not in got and "40_gone.sql" not in got and "300_gone.sql" in got
    assert got["2_b.sql"][0] == "edited"


def test_copied_rollbacks_make_new_scripts_wait(scripts, registry):
    got = final(P.next_registry(scripts(DIRECTORY), registry(REGISTRY), P.ASK, execute=False))
    assert set(got) == {"1_a.sql", "2_b.sql"}


def test_no_pairs_deletes_everything_and_continues(scripts, registry):
    directory = scripts({"1_a.sql": "x", "900_n.sql": "y"})
    before = registry({"1_a.sql": "x", "600_alone.sql": "z"})
    for mode, execute in ((P.ASK, False), (P.FORCE_EXECUTE, True), (P.SKIP, True)):
        assert set(final(P.next_registry(directory, before, mode, execute))) == {"1_a.sql", "900_n.sql"}


def test_failure_is_recorded_and_later_scripts_are_not(scripts, registry, spark):
    directory = scripts(["100_a.sql", "200_b.sql", "300_c.sql", "5_d.sql", "6_e_rollback.sql", "1_z.sql"])
    before = registry(["1_z.sql"])
    outcomes = spark.createDataFrame([("200_b.sql", 1), ("300_c.sql", 0)], "name string, exit_code int")
    got = final(P.next_registry(directory, before, P.SKIP, True, outcomes=outcomes))
    assert {n: s for n, (_, s) in got.items()} == {
        "1_z.sql": 0,
        "100_a.sql": N.EXECUTED,
        "200_b.sql": N.EXECUTED_WITH_ERRORS,
        "6_e_rollback.sql": N.EXECUTED,
    }
    ignoring = final(P.next_registry(directory, before, P.SKIP, True, outcomes=outcomes, ignore_errors=True))
    assert set(ignoring) == {r.name for r in directory.collect()}


def test_unsupported_schema_stops_before_it(scripts, registry):
    directory = scripts(["100_a.sql", "200_b_perfstat.sql", "300_c.sql", "1_z.sql"])
    got = final(P.next_registry(directory, registry(["1_z.sql"]), P.SKIP, True))
    assert set(got) == {"1_z.sql", "100_a.sql"}
    plan = {r.name: r.action for r in P.forward_plan(directory, registry(["1_z.sql"])).collect()}
    assert plan["200_b_perfstat.sql"] == "unsupported"


def test_first_run_records_everything(scripts, registry, spark):
    outcomes = spark.createDataFrame([("100_a.sql", 1)], "name string, exit_code int")
    directory = scripts(["100_a.sql", "200_b.sql", "dev.sql"])
    empty = registry([])
    got = final(P.next_registry(directory, empty, P.ASK, True, outcomes=outcomes))
    assert {n: s for n, (_, s) in got.items()} == {"100_a.sql": 0, "200_b.sql": 0}
    assert names(G.bootstrap_registry(directory)) == {"100_a.sql", "200_b.sql"}
    assert G.registry_count(empty).first().first_run


def test_omit_changed_keeps_old_text(scripts, registry):
    got = final(P.next_registry(scripts(DIRECTORY), registry(REGISTRY), P.SKIP, True, omit_changed=True))
    assert got["2_b.sql"] == ("old", 0)


def test_one_forward_script_is_undone_once(scripts, registry):
    # Both rollbacks resolve to 5_fix.sql; the later in name order runs first.
    before = registry(["5_fix.sql", "5_fix_rollback.sql", "5_fix_rollback_rollback.sql", "1_a.sql"])
    plan = {r.name: (r.action, r.effect) for r in P.rollback_plan(scripts(["1_a.sql"]), before, P.FORCE_EXECUTE, True).collect()}
    assert plan == {
        "5_fix.sql": ("undone", "delete"),
        "5_fix_rollback_rollback.sql": ("run", "delete"),
        "5_fix_rollback.sql": ("none", "keep"),
    }


def test_random_reconcile_against_dicts(scripts, registry):
    rng = random.Random(3)
    pool = [f"{i}_s{i % 5}.sql" for i in range(60)]
    for _ in range(3):
        left = {n: str(rng.randrange(2)) for n in pool if rng.random() < 0.6}
        right = {n: str(rng.randrange(2)) for n in pool if rng.random() < 0.6}
        want = {
            n: "new" if n not in right else "deleted" if n not in left else "unchanged" if left[n] == right[n] else "updated"
            for n in left | right
        }
        assert {r.name: r.change for r in R.reconcile(scripts(left), registry(right)).collect()} == want


def test_a_run_starts_from_the_registry_of_the_last_one(scripts, registry, spark):
    first = P.next_registry(scripts(["1_a.sql", "2_b.sql"]), registry([]), execute=True)
    outcomes = spark.createDataFrame([("3_c.sql", 0), ("3_c.sql", 1)], "name string, exit_code int")
    second = P.next_registry(scripts(["1_a.sql", "2_b.sql", "3_c.sql"]), first, execute=True, outcomes=outcomes)
    got = sorted((r.name, r.status) for r in second.collect())
    assert [name for name, _ in got] == ["1_a.sql", "2_b.sql", "3_c.sql"] and got[2][1] != 0
