"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerframe", cores: str = "*", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for, local unless ``master`` is given.

    A local session has as many shuffle partitions as cores; on a cluster the setting of the
    cluster holds.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    if master is None:
        count = str(os.cpu_count() or 8) if cores == "*" else cores
        settings = {"spark.sql.shuffle.partitions": count, **settings}
    builder = SparkSession.builder.master(master or f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is made only when the setting is unset and the
    session is local, where driver and executors share one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="ledgerframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For slim tables that several branches of a plan read: the work behind them is done
    once, survives the loss of executors, and Spark knows the size of the result.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
