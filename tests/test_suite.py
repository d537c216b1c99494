"""Every registered query against its check, over whole tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from ledgerframe import suite
from ledgerframe.suite.fixtures import VIEWS, frame, needed, with_views

SF_DIR = os.environ.get("LEDGERFRAME_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_equals_check(spark, con, name):
    got, want = compare(suite.queries()[name](spark, SF_DIR), con, suite.oracle_sql()[name])
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_check():
    assert set(suite.queries()) == set(suite.oracle_sql())
    assert set(suite.queries()) <= set(entry.queries())


def test_views_are_whole():
    """No view or check trims texts or caps rows."""
    for text in [*VIEWS.values(), *suite.oracle_sql().values()]:
        assert not re.search(r"\b(substr|substring|limit|sample|tablesample)\b", text, re.I)


def test_needed_views_come_in_order():
    assert needed("select * from stored_ddl join change_files using (x)") == ["change_files", "ddl_corpus", "stored_ddl"]
    assert with_views("select 1") == "select 1"
    merged = with_views("with a as (select * from objects) select * from a")
    assert merged.count("with ") == 1 and merged.index("objects as") < merged.index("a as (select * from objects)")


@pytest.mark.parametrize("view", ["ddl_corpus", "stored_ddl"])
def test_long_definitions_of_a_small_table_are_made_by_all_cores(spark, view):
    rows = frame(spark, SF_DIR, view).where("object_type = 'TABLE' and object_name not like 'GONE%'")
    assert rows.select("ddl").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_arrivals_are_not_dealt_into_a_fixed_number_of_files(spark, monkeypatch):
    from ledgerframe.suite import files, registry

    made, fresh = {}, files.fresh_path

    def noted(session, label):
        made[label] = fresh(session, label)
        return made[label]

    monkeypatch.setattr(files, "fresh_path", noted)
    monkeypatch.setattr(registry, "frame", lambda session, sf_dir, view: frame(session, sf_dir, view).repartition(9))
    suite.queries()["reconcile_stream"](spark, SF_DIR)
    assert len(spark.read.parquet(made["arrivals"]).inputFiles()) == 9
    # the seed and two batches
    assert len([n for n in os.listdir(made["registry"]) if n.startswith("run=")]) == 3
