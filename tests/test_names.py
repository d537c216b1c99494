import pytest
from pyspark.sql import functions as F

from ledgerframe.functions import names as N
from ledgerframe.operators import ordering as O
from ledgerframe.operators import reconcile as R


def apply(spark, rule, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select("i", rule(F.col("v")).alias("r")).select("r").collect()]


EXAMPLES = [
    (N.schema_type, "8_a_user.sql", "USER"),
    (N.schema_type, "8_pkg_user.sql", "OWNER"),
    (N.schema_type, "8_pkg_ext_imp_user.sql", "OWNER"),
    (N.schema_type, "8_a_user_rollback.sql", "OWNER"),
    (N.schema_type, "8_a_rpt.sql", "RPT"),
    (N.schema_type, "8_pkg_config_field_rpt.sql", "OWNER"),
    (N.schema_type, "8_a_PKG.sql", "PKG"),
    (N.schema_type, "8_a_perfstat.sql", "PERFSTAT"),
    (N.effective_schema, "8_a_user_rollback.sql", "USER"),
    (N.script_type, "8_a_rollback.sql", N.ROLLBACK),
    (N.script_type, "8_a_ROLLBACK.sql", N.COMMIT),
    (N.commit_name, "5_fix_rollback_bug_rollback.sql", "5_fix_bug.sql"),
    (lambda n: N.commit_name(n, strict=True), "5_fix_rollback_bug_rollback.sql", "5_fix_rollback_bug.sql"),
    (N.commit_name, "5_fix_rollback_bug.sql", "5_fix_rollback_bug.sql"),
    (N.rollback_name, "5_a.sql", "5_a_rollback.sql"),
    (N.rollback_name, "5_a_rollback.sql", "5_a_rollback.sql"),
    (N.order_number, "0012_a.sql", 12),
    (N.order_number, "12", 12),
    (N.order_number, "12.sql", None),
    (N.order_number, "_a.sql", None),
    (N.order_number, "x1_a.sql", None),
    (N.order_number, "2147483648_a.sql", 2147483648),
    (N.execution_band, "001_x.sql", N.COMMON_BAND),
    (N.execution_band, "99_x.sql", N.UNDER_HUNDRED_BAND),
]


@pytest.mark.parametrize("rule,name,expected", EXAMPLES)
def test_name_rules(spark, rule, name, expected):
    assert apply(spark, rule, [name]) == [expected]


def test_zero_padded_number_is_development_and_common(spark, scripts):
    frame = scripts(["001_x.sql", "150_y.sql"])
    assert [r.name for r in R.development_scripts(frame).collect()] == ["001_x.sql"]
    assert apply(spark, N.execution_band, ["001_x.sql"]) == [N.COMMON_BAND]


def test_ignored_names(scripts):
    frame = scripts(["12_.sql", "12.sql", "_a.sql", "x1_a.sql", "12_a.sql"])
    assert {r.name for r in R.ignored_scripts(frame).collect()} == {"12.sql", "_a.sql", "x1_a.sql"}
    assert {r.name for r in R.valid_scripts(frame).collect()} == {"12_.sql", "12_a.sql"}


def test_fingerprint_folds_windows_line_ends_only(spark):
    same = apply(spark, N.fingerprint, ["a\r\nb", "a\nb", "a\rb"])
    assert same[0] == same[1] == "fcd127ffa1016069006ad91f3f361248f9bdf272"
    assert same[2] != same[0]


def test_duration(spark):
    frame = spark.createDataFrame([(0,), (61001,), (3600000 * 100 + 5,)], "ms bigint")
    got = [r[0] for r in frame.select(N.duration_hms(F.col("ms"))).collect()]
    assert got == ["00:00:00.000", "00:01:01.001", "100:00:00.005"]


SAMPLE = ["7_rates.sql", "7_rates_rollback.sql", "4120_fees.sql", "4120_fees_rollback.sql"]


def test_commit_order_runs_long_numbers_first(scripts):
    assert [r.name for r in O.commit_order(scripts(SAMPLE)).collect()] == ["4120_fees.sql", "7_rates.sql"]


def test_rollback_order_is_the_reverse(scripts):
    got = [r.name for r in O.rollback_order(scripts(SAMPLE)).collect()]
    assert got == ["7_rates_rollback.sql", "4120_fees_rollback.sql"]


def test_orders_against_python(scripts):
    names = [f"{n}_{s}{r}.sql" for n in (1, 7, 99, 100, 101, 2500, 99999) for s in "ba" for r in ("", "_rollback")]
    key = lambda n: (int(n.split("_")[0]), n)
    small = lambda n: len(n.split("_")[0]) < 3
    commits = [n for n in names if "rollback" not in n]
    rollbacks = [n for n in names if "rollback" in n]
    frame = scripts(names)
    assert [r.name for r in O.natural_order(frame).collect()] == sorted(names, key=key)
    assert [r.name for r in O.commit_order(frame).collect()] == sorted(commits, key=lambda n: (small(n), *key(n)))
    assert [r.name for r in O.rollback_order(frame).collect()] == sorted(
        rollbacks, key=lambda n: (small(n), *key(n)), reverse=True
    )


def test_execution_profile(scripts):
    frame = scripts({"1_a.sql": "create package p as", "2_b.sql": "select 1", "3_c_user.sql": "x"})
    got = {r.name: (r.wrapper, r.enable_locked) for r in O.execution_profile(frame, True).collect()}
    assert got == {
        "1_a.sql": ("compile_invalids_not_fail_on_error", 0),
        "2_b.sql": ("compile_invalids_not_fail_on_error", 1),
        "3_c_user.sql": ("plain_not_fail_on_error", 0),
    }
