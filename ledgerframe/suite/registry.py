"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.suite.fixtures import frame, with_views


@dataclass(frozen=True)
class Inputs:
    """The given tables and derived views of one data folder."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, view: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, view)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a function of ``Inputs`` under a name, with its checking SQL."""

    def wrap(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = with_views(check)
        return build

    return wrap
