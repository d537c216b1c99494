"""From scripts in development or changed to the objects and definition files that they ask for."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerframe import suite
from ledgerframe.functions import names as N
from ledgerframe.operators import impact as I

SF_DIR = os.environ.get("LEDGERFRAME_TEST_DIR", "/root/testdata/sf0.001")

SCRIPTS = [
    ("50_dev.sql", "create table t_dev (a number);"),  # in development, as registered
    ("200_same.sql", "create table t_same (a number);"),  # as registered
    ("201_changed.sql", "create table t_new (a number);"),  # registered with another text
    ("202_breaks.sql", "create table t_breaks\r\n(a number);"),  # other line breaks only
    ("203_fresh.sql", "create table t_fresh (a number);"),  # not registered
    ("204_changed_rollback.sql", "drop table t_rollback;"),
    ("205_changed_user.sql", "create table t_user (a number);"),
    ("nonumber.sql", "create table t_unnumbered (a number);"),
    ("206_null.sql", None),
    ("207_empty.sql", ""),
]
KNOWN = [
    (1, "50_dev.sql", "create table t_dev (a number);"),
    (2, "200_same.sql", "create table t_old (a number);"),  # an older row of the name
    (3, "200_same.sql", "create table t_same (a number);"),
    (4, "201_changed.sql", "create table t_before (a number);"),
    (5, "202_breaks.sql", "create table t_breaks\n(a number);"),
    (6, "204_changed_rollback.sql", "drop table t_other;"),
    (7, "205_changed_user.sql", "create table t_other (a number);"),
    (8, "nonumber.sql", "x"),
    (9, "206_null.sql", "x"),
    (10, "207_empty.sql", "create table t_was (a number);"),
]


@pytest.fixture(scope="module")
def sides(spark):
    scripts = spark.createDataFrame(SCRIPTS, "name string, text string")
    known = spark.createDataFrame(KNOWN, "script_id long, name string, text string").withColumn("status", F.lit(0))
    return scripts, known.withColumn("file_hash", N.fingerprint(F.col("text")))


def test_candidates_are_in_development_or_changed(sides):
    assert sorted(r.name for r in I.candidate_names(*sides).collect()) == ["201_changed.sql", "207_empty.sql", "50_dev.sql"]
    found = {(r.object_name.lower(), r.object_type) for r in I.candidate_objects(*sides).collect()}
    assert found == {("t_dev", "TABLE"), ("t_new", "TABLE")}


def test_candidates_of_no_scripts(sides):
    scripts, known = sides
    assert I.candidate_objects(scripts.limit(0), known).count() == 0
    assert {r.name for r in I.candidate_names(scripts, known.limit(0)).collect()} == {"50_dev.sql"}


def test_no_text_below_the_join(sides):
    """Either side of the join gives names and fingerprints only."""
    plan = I.candidate_names(*sides)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().apply(0)
    for side in range(2):
        out = plan.children().apply(side).output()
        assert "text" not in {out.apply(i).name() for i in range(out.size())}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_candidates_ask_for_a_part_of_all_files(spark):
    asked = suite.queries()["candidate_definitions"](spark, SF_DIR).select("path", "part")
    every = suite.queries()["regenerated_definitions"](spark, SF_DIR).select("path", "part")
    assert 0 < asked.count() <= every.count()
    assert asked.exceptAll(every).count() == 0
