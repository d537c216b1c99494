"""Forward and rollback plans, and the registry after one run.

Decisions are taken on a slim table of names and fingerprints that is compared once
and written; script text is joined at the end, once. Decisions that hang on the whole
data set (are there pairs? which script failed first?) are uncorrelated scalar
subqueries over aggregates that combine before the shuffle, so nothing is collected
and no row is paired with every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.operators import reconcile as R
from ledgerframe.operators.ordering import with_position
from ledgerframe.operators.registry import with_fingerprint
from ledgerframe.operators.skew import dealt_by_bytes
from ledgerframe.session import materialize

ASK, SKIP, FORCE_EXECUTE = "ASK", "SKIP", "FORCE_EXECUTE"
UNSUPPORTED_SCHEMAS = ("PERFSTAT",)
PLAN_COLUMNS = ["name", "type", "band", "order_number", "action", "effect"]


def run_key() -> Column:
    """Ascending for forward scripts, descending for rollbacks."""
    return F.struct("band", "order_number", "name")


def rollback_branch(mode: str, execute: bool, confirm: bool) -> str:
    """What happens to pairs, if there are any: run, copy or list them."""
    if mode not in (ASK, SKIP, FORCE_EXECUTE):
        raise ValueError(f"unknown rollback mode {mode!r}")
    if mode == SKIP:
        return "list"
    if execute and (mode == FORCE_EXECUTE or confirm):
        return "run"
    return "copy"


def forward_plan(directory: DataFrame, registry: DataFrame, execute: bool = True) -> DataFrame:
    """New scripts with their action; rollbacks are registered first, never run.

    Ascending (phase, band, order_number, name) is the order of the run; ``positioned`` numbers
    it. A script whose number is out of range has no place in it: it is ``quarantined``.
    """
    fresh = N.with_script_facts(R.new_scripts(directory.select("name"), registry))
    is_rollback = F.col("type") == N.ROLLBACK
    stuck = F.col("schema_type").isin(*UNSUPPORTED_SCHEMAS)
    commit_action = F.when(stuck, "unsupported").otherwise("execute") if execute else F.lit("copy")
    return fresh.select(
        F.when(is_rollback, F.lit(0)).otherwise(F.lit(1)).alias("phase"),
        "band",
        "order_number",
        "name",
        "schema_type",
        F.when(N.is_quarantined(F.col("name")), "quarantined")
        .when(is_rollback, "register")
        .otherwise(commit_action)
        .alias("action"),
    )


def positioned(plan: DataFrame) -> DataFrame:
    """A forward plan with the gapless ``position`` of every script in the run, from 1.

    Quarantined scripts are not part of the run and have no position.
    """
    order = [F.col(c) for c in ("phase", "band", "order_number", "name")]
    placed = with_position(plan.where("action <> 'quarantined'"), order)
    out = plan.where("action = 'quarantined'").withColumn("position", F.lit(None).cast("bigint"))
    return placed.unionByName(out)


def undo_groups(deleted: DataFrame, strict: bool) -> DataFrame:
    """(commit_name, step): forward names to undo and the rollback that does it.

    Several rollbacks can resolve to one forward name; the first in rollback order runs.
    """
    return (
        deleted.where(~N.is_quarantined(F.col("name")))
        .groupBy(N.commit_name(F.col("name"), strict).alias("commit_name"))
        .agg(
            F.max(F.col("type") == N.COMMIT).alias("has_commit"),
            F.max(F.when(F.col("type") == N.ROLLBACK, run_key())).alias("step"),
        )
        .where(F.col("has_commit") & F.col("step").isNotNull())
        .select("commit_name", "step")
    )


def count_of(frame: DataFrame) -> Column:
    return frame.agg(F.count(F.lit(1)).alias("n")).scalar()


def first_failed_step(groups: DataFrame, outcomes: DataFrame | None) -> Column | None:
    """The first rollback in rollback order whose exit code is not zero."""
    if outcomes is None:
        return None
    codes = outcomes.where("exit_code <> 0").select("name")
    failed = groups.select("step.*").join(codes, "name", "left_semi")
    return failed.agg(F.max(run_key()).alias("k")).scalar()


def decide_rollbacks(
    deleted: DataFrame, branch: str, outcomes: DataFrame | None, strict: bool
) -> DataFrame:
    """Action and effect for each row of a slim table of deleted names."""
    groups = undo_groups(deleted, strict)
    name, step = F.col("name"), F.col("step")
    keyed = deleted.withColumn("commit_name", N.commit_name(name, strict))
    marked = keyed.join(groups, "commit_name", "left")
    if branch == "run":
        first_fail = first_failed_step(groups, outcomes)
        reached = F.lit(True) if first_fail is None else first_fail.isNull() | (step >= first_fail)
        acts = F.when(name == step["name"], F.when(reached, "run").otherwise("not_reached")).when(
            name == F.col("commit_name"), F.when(reached, "undone").otherwise("not_reached")
        )
        gone = F.col("action").isin("run", "undone") | (count_of(groups) == 0)
    else:
        acts = F.when(F.col("type") == N.ROLLBACK, F.lit(branch))
        gone = F.lit(True)
    lost = N.is_quarantined(name)
    action = F.when(lost, "quarantined").otherwise(F.coalesce(F.when(step.isNotNull(), acts), F.lit("none")))
    effect = F.when(gone & ~lost, "delete").otherwise("keep")
    return marked.withColumn("action", action).withColumn("effect", effect).select(*PLAN_COLUMNS)


def rollback_plan(
    directory: DataFrame,
    registry: DataFrame,
    mode: str = ASK,
    execute: bool = False,
    confirm: bool = False,
    outcomes: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Every deleted registry row with an action and its effect on the row.

    Rows whose number is out of range are ``quarantined`` and stay.

    ``outcomes`` (name, exit_code) stops a forced run behind its first failure; the
    failing pair is gone from the registry, later ones are ``not_reached``.
    """
    deleted = N.with_script_facts(R.deleted_names(directory, registry).select("name"))
    slim = materialize(deleted, "deleted")
    return decide_rollbacks(slim, rollback_branch(mode, execute, confirm), outcomes, strict)


def decide_inserts(
    snapshot: DataFrame, execute: bool, outcomes: DataFrame | None, ignore_errors: bool, unsupported: tuple[str, ...]
) -> DataFrame:
    """New names with the status they are recorded with, cut behind a failure.

    Quarantined scripts are not run, and so not recorded.
    """
    fresh = snapshot.where(F.col("change") == "new").where(~N.is_quarantined(F.col("name")))
    if not execute:
        return fresh.withColumn("status", F.lit(N.EXECUTED))
    if outcomes is None:
        fresh = fresh.withColumn("exit_code", F.lit(0))
    else:
        # of several outcomes of a script the highest code counts: one failure is a failure
        codes = outcomes.groupBy("name").agg(F.max(F.abs("exit_code")).alias("exit_code"))
        fresh = fresh.join(codes, "name", "left")
    code = F.coalesce("exit_code", F.lit(0))
    is_commit = F.col("type") == N.COMMIT
    failed = F.lit(False) if ignore_errors else is_commit & (code != 0)
    stuck = is_commit & F.col("schema_type").isin(*unsupported) if unsupported else F.lit(False)
    stops = fresh.agg(
        F.struct(
            F.min(F.when(failed, run_key())).alias("failed"), F.min(F.when(stuck, run_key())).alias("stuck")
        ).alias("stop")
    ).scalar()
    within = (stops["failed"].isNull() | (run_key() <= stops["failed"])) & (
        stops["stuck"].isNull() | (run_key() < stops["stuck"])
    )
    first_run = count_of(snapshot.where("change <> 'new'")) == 0
    ran = F.when(~is_commit | first_run, F.lit(N.EXECUTED)).otherwise(N.status_of_exit_code(code))
    return fresh.where(~is_commit | first_run | within).withColumn("status", ran)


def next_registry(
    directory: DataFrame,
    registry: DataFrame,
    mode: str = ASK,
    execute: bool = False,
    confirm: bool = False,
    outcomes: DataFrame | None = None,
    ignore_errors: bool = False,
    omit_changed: bool = False,
    unsupported: tuple[str, ...] = UNSUPPORTED_SCHEMAS,
    raise_on_orphans: bool = False,
    strict: bool = False,
) -> DataFrame:
    """The registry after one run: updates, then deletions, then new scripts.

    New scripts wait for the next run when rollbacks were copied out for a person to
    run, or when one failed. ``outcomes`` holds exit codes by script name; a script
    without one counts as successful, and of several the worst counts. The result is unique on
    the name and needs no ids: it can be the registry of the next run. On an empty registry every script is recorded as
    executed and none is run.
    """
    if raise_on_orphans:
        R.orphaned_rollbacks(directory, registry, raise_on=True)
    compared = R.compare(directory, registry, sized=True).withColumnsRenamed({"type": "reg_type", "status": "reg_status"})
    snapshot = materialize(N.with_script_facts(compared), "snapshot")
    branch = rollback_branch(mode, execute, confirm)
    deleted = snapshot.where("change = 'deleted'")
    plan = decide_rollbacks(deleted, branch, outcomes, strict)
    inserts = decide_inserts(snapshot, execute, outcomes, ignore_errors, unsupported)
    groups = undo_groups(deleted, strict)
    if branch == "copy":
        inserts = inserts.where(count_of(groups) == 0)
    elif branch == "run" and outcomes is not None:
        inserts = inserts.where(first_failed_step(groups, outcomes).isNull())

    from_registry = snapshot.where("change = 'unchanged'" if not omit_changed else "change in ('unchanged', 'updated')")
    kept_deleted = deleted.join(plan.where("effect = 'keep'"), "name", "left_semi")
    from_registry = from_registry.unionByName(kept_deleted).select("name", "script_id")
    arriving = inserts.select("name", "type", F.col("status").cast("int").alias("status"))
    if not omit_changed:
        updated = snapshot.where("change = 'updated'")
        arriving = arriving.unionByName(
            updated.select("name", F.col("reg_type").alias("type"), F.col("reg_status").alias("status"))
        )
    shared_ts = ["ts"] if "ts" in directory.columns and "ts" in registry.columns else []
    fields = ["name", "file_hash", "text", *shared_ts, "type", "status"]
    keys = [c for c in ("name", "script_id") if c in registry.columns]
    # the tasks of the joins with texts are as many as the bytes of all texts ask for
    size = snapshot.agg(F.sum("reg_bytes").alias("reg"), F.sum("dir_bytes").alias("dir")).first()
    staying = dealt_by_bytes(from_registry.select(*keys), keys, size["reg"])
    coming = dealt_by_bytes(arriving, ["name"], size["dir"])
    old_rows = with_fingerprint(registry).join(staying, keys, "left_semi")
    new_rows = with_fingerprint(R.valid_scripts(directory)).join(coming, "name")
    return old_rows.select(*fields).unionByName(new_rows.select(*fields))
