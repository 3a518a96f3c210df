import math

from skein.operators.copies import NUMBER, TEXT, diff_copies, max_abs_difference

FIELDS = {"v": NUMBER, "ok": NUMBER, "t": TEXT}
SCHEMA = "k long, s long, v double, ok boolean, t string, at long, difference string, field int"


def rows(spark, left, right, **options):
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    found = diff_copies(a, b, ["k", "s"], FIELDS, latest="at", names=("a", "b"), **options)
    return sorted(tuple(r) for r in found.collect())


def test_differences_field_by_field(spark):
    left = [(1, 0, 1.0, True, "x", 1, "c", 1), (2, 0, math.nan, True, "x", 1, "c", 1), (3, 0, 1.0, None, " X", 1, "c", 1)]
    right = [(1, 0, 1.0 + 1e-12, True, "X ", 1, "c", 1), (2, 0, None, False, "y", 1, "c", 1), (4, 0, 1.0, True, "x", 1, "c", 1)]
    assert rows(spark, left, right) == [(2, 0, "ok"), (2, 0, "t"), (3, 0, "only_in_a"), (4, 0, "only_in_b")]


def test_missing_on_one_side_and_infinities(spark):
    left = [(1, 0, None, None, None, 1, "", 1), (2, 0, math.inf, True, "x", 1, "", 1)]
    right = [(1, 0, 1.0, None, "x", 1, "", 1), (2, 0, math.inf, True, "x", 1, "", 1)]
    assert rows(spark, left, right) == [(1, 0, "t"), (1, 0, "v")]


def test_latest_row_counts_and_repeats_are_silent(spark):
    left = [(1, 0, 5.0, True, "x", 1, "", 1), (1, 0, 1.0, True, "x", 2, "", 1), (1, 0, 1.0, True, "x", 2, "", 1)]
    right = [(1, 0, 1.0, True, "x", 9, "", 1), (1, 0, 7.0, True, "x", None, "", 1)]
    assert rows(spark, left, right) == []


def test_null_keys_and_empty_sides(spark):
    one = [(None, None, 1.0, True, "x", 1, "", 1)]
    assert rows(spark, one, one) == []
    assert rows(spark, one, []) == [(None, None, "only_in_a")]
    assert rows(spark, [], []) == []


def test_one_shuffle(spark):
    a = spark.range(9).selectExpr("id k", "id s", "1D v", "true ok", "'x' t", "id at")
    plan = diff_copies(a, a, ["k", "s"], FIELDS, latest="at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_max_abs_difference(spark):
    a = spark.createDataFrame([(1, 1.0, math.nan), (2, 2.0, 3.0)], "k long, m double, n double")
    b = spark.createDataFrame([(1, 1.5, None), (2, 2.0, 3.0)], "k long, m double, n double")
    assert {r.metric: (r.all_close, r.max_abs_difference) for r in max_abs_difference(a, b, ["k"], ["m", "n"]).collect()} == {"m": (False, 0.5), "n": (True, 0.0)}
