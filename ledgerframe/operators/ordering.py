"""Execution orders and the replay of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.functions.text import is_package_script
from ledgerframe.operators.skew import HOT_ROWS, join_counted
from ledgerframe.session import materialize


def natural_order(scripts: DataFrame) -> DataFrame:
    """Unnumbered names first, then by number and name (a range-partitioned sort)."""
    return N.with_script_facts(scripts).orderBy(F.asc_nulls_first("order_number"), "name")


def commit_order(scripts: DataFrame) -> DataFrame:
    """Forward scripts as they run: three-digit numbers first, then the rest."""
    forward = N.with_script_facts(scripts).where(F.col("type") == N.COMMIT)
    return forward.orderBy("band", F.asc_nulls_first("order_number"), "name")


def rollback_order(scripts: DataFrame) -> DataFrame:
    """Rollbacks as they run: the exact reverse, small numbers first."""
    back = N.with_script_facts(scripts).where(F.col("type") == N.ROLLBACK)
    return back.orderBy(F.desc("band"), F.desc_nulls_last("order_number"), F.desc("name"))


def with_position(frame: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Gapless positions from 1 in the given order, without a window over all rows.

    Rows are range-partitioned, sorted and written, so that a row's place can't change; the sizes of
    the partitions, one row each, give the first position of every partition.
    """
    placed = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(starts, "_part").withColumn(name, F.col("_start") + inside + 1)
    return joined.select(*frame.columns, name)


def commit_positions(scripts: DataFrame) -> DataFrame:
    """Forward scripts with their position in ``commit_order``; numbers out of range have none."""
    forward = N.with_script_facts(scripts).where((F.col("type") == N.COMMIT) & F.col("order_number").isNotNull())
    return with_position(forward, [F.col(c) for c in ("band", "order_number", "name")])


def rollback_positions(scripts: DataFrame) -> DataFrame:
    """Rollbacks with their position in ``rollback_order``; numbers out of range have none."""
    back = N.with_script_facts(scripts).where((F.col("type") == N.ROLLBACK) & F.col("order_number").isNotNull())
    return with_position(back, [F.desc(c) for c in ("band", "order_number", "name")])


def execution_profile(scripts: DataFrame, ignore_errors: bool = False) -> DataFrame:
    """How each script would be run: schema, wrapper and the locked-component switch."""
    name = F.col("name")
    schema = N.schema_type(name)
    compiles = schema == N.OWNER
    tail = "not_fail_on_error" if ignore_errors else "fail_on_error"
    wrapper = F.when(compiles, f"compile_invalids_{tail}").otherwise(f"plain_{tail}")
    unlocked = compiles & ~is_package_script(F.col("text"))
    return scripts.select(
        "name",
        schema.alias("schema_type"),
        N.effective_schema(name).alias("effective_schema"),
        wrapper.alias("wrapper"),
        F.when(unlocked, F.lit(1)).otherwise(F.lit(0)).alias("enable_locked"),
    )


def step_key() -> Column:
    return F.struct("ts", "step_id")


def first_failures(log: DataFrame) -> DataFrame:
    """Per failed run the earliest failing (ts, step_id).

    Only failing rows reach the aggregate, which has to sort because its value is a
    struct; the filter is pushed to the scan.
    """
    failing = log.where(F.col("exit_code") != 0)
    return failing.groupBy("run_id").agg(F.min(step_key()).alias("first_fail"))


def run_facts(log: DataFrame) -> DataFrame:
    """Per run its number of rows and first failure; both sides share one partitioning."""
    counts = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(first_failures(log), "run_id", "left")


def is_recorded() -> Column:
    return F.col("first_fail").isNull() | (step_key() <= F.col("first_fail"))


def run_until_failure(
    log: DataFrame, ignore_errors: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The steps that get recorded: all up to and including a run's first failure."""
    columns = [F.col(c) for c in log.columns]
    status = N.status_of_exit_code(F.col("exit_code")).alias("status")
    if ignore_errors:
        return log.select(*columns, status)
    marked = join_counted(log, run_facts(log), ["run_id"], "inner", hot_rows=hot_rows)
    return marked.where(is_recorded()).select(*columns, status)


def run_summary(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per run: steps recorded and left, the first failing step, recorded time."""
    marked = join_counted(log, run_facts(log), ["run_id"], "inner", hot_rows=hot_rows)
    recorded = is_recorded()
    elapsed = F.sum(F.when(recorded, N.elapsed_ms(F.col("seconds")))).alias("elapsed_ms")
    summary = marked.groupBy("run_id").agg(
        F.count(F.when(recorded, 1)).alias("steps_recorded"),
        F.count(F.when(~recorded, 1)).alias("steps_remaining"),
        F.min("first_fail.step_id").alias("first_failed_step"),
        elapsed,
    )
    return summary.withColumn("elapsed", N.duration_hms(F.col("elapsed_ms")))


def failed_runs(log: DataFrame) -> DataFrame:
    """Runs with a failure and the step that stopped them."""
    return first_failures(log).select(
        "run_id",
        F.col("first_fail.step_id").alias("first_failed_step"),
        F.col("first_fail.ts").alias("failed_at"),
    )
