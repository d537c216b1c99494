"""``run_until_failure`` over a stream of steps, as a stateful operator.

The state is one value per (run, lane), the first failure seen there; runs that don't fail have
none. A lane is a salt of the step, so a run that fills a batch is dealt over many tasks. Runs and
lanes are dealt into a fixed number of groups, and a group keeps its failures in one value, so that
the state is asked once per group and batch, not per run: a call takes longer than judging hundreds
of steps. A batch reads the groups of its own steps alone. A step that comes after its lane's failure is dropped for good; every other one is written, once, by the file
sink. A batch is read in one pass and a step is judged as it comes, so what is written can still hold
steps beyond a failure of another lane, or of a later row. ``recorded_steps`` folds that when it reads:
the first failure of each run is among the written steps, whatever the order in which they came.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerframe.operators import ordering as O

#: Lanes of a run.
LANES = 16
#: Groups of lanes, fixed for a checkpoint.
GROUPS = 256
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sorts as timestamps do.
TIME_KEY = "yyyy-MM-dd HH:mm:ss.SSSSSS"


class FirstFailure(StatefulProcessor):
    """Passes on the steps of each lane up to the first failure seen there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", T.StructType([T.StructField("places", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # lane -> [time, step] of its first failure
        known = json.loads(self.first.get()[0]) if self.first.exists() else {}
        changed = False
        for steps in rows:
            place = [[at, step] for at, step in zip(steps["at__"].tolist(), steps["step__"].tolist(), strict=True)]
            lanes = steps["lane__"].tolist()
            # a step without time or number has no place; the fold decides about it
            for lane, at, failed in zip(lanes, place, steps["failed__"].tolist(), strict=True):
                if failed and at[0] and (lane not in known or at < known[lane]):
                    known[lane] = at
                    changed = True
            kept = [not at[0] or lane not in known or at <= known[lane] for lane, at in zip(lanes, place, strict=True)]
            yield steps[kept].drop(columns=["group__", "lane__", "at__", "step__", "failed__"])
        if changed:
            self.first.update((json.dumps(known, separators=(",", ":")),))

    def close(self) -> None:
        pass


def stepped(steps: DataFrame, lanes: int = LANES) -> DataFrame:
    """The steps that a lane's known failure doesn't rule out; the columns of ``steps``."""
    known = F.col("ts").isNotNull() & F.col("step_id").isNotNull()
    # columns travel as text, so that a missing value stays one
    carried = [F.col(c).cast("string").alias(c) for c in steps.columns]
    salt = F.pmod(F.xxhash64("ts", "step_id"), F.lit(lanes)).cast("string")
    dealt = steps.select(
        *carried,
        F.concat_ws("/", salt, F.col("run_id").cast("string")).alias("lane__"),
        F.when(known, F.date_format("ts", TIME_KEY)).otherwise("").alias("at__"),
        F.coalesce("step_id", F.lit(0)).cast("long").alias("step__"),
        F.coalesce(F.col("exit_code") != 0, F.lit(False)).alias("failed__"),
    )
    grouped = dealt.withColumn("group__", F.pmod(F.xxhash64("lane__"), F.lit(GROUPS)).cast("int"))
    passed = grouped.groupBy("group__").transformWithStateInPandas(
        statefulProcessor=FirstFailure(),
        outputStructType=T.StructType([T.StructField(c, T.StringType()) for c in steps.columns]),
        outputMode="Append",
        timeMode="None",
    )
    return passed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in steps.schema.fields])


def run_log_stream(steps: DataFrame, root: str, checkpoint: str, lanes: int = LANES) -> StreamingQuery:
    """Keep the steps of ``run_until_failure`` below ``root/recorded``, for ``recorded_steps`` to read.

    Steps may come in any order. After a stop the stream goes on from its checkpoint.
    """
    spark = steps.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        return (
            stepped(steps, lanes)
            .writeStream.format("parquet")
            .option("path", f"{root}/recorded")
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        # the query has a copy of the settings
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def recorded_steps(spark: SparkSession, root: str) -> DataFrame:
    """The steps recorded so far, with their status."""
    return O.run_until_failure(spark.read.parquet(f"{root}/recorded"))
