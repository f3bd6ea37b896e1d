import datetime as dt

import pytest

from tarnlake import operators as op
from tarnlake.functions import days_between
from tarnlake.plans import profile_all


def one(df):
    return df.first().asDict()


def test_null_is_a_value(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "k int")
    assert one(op.distinct_counts(df))["n"] == 3
    assert one(op.column_duplicates(df, "k")) == {"total": 5, "distinct": 3, "duplicates": 2}
    assert sorted(op.key_violations(df, ["k"]).collect(), key=str) == [(1, 2), (None, 2)]


def test_floats_compare_as_grouped(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,)], "x double")
    assert one(op.duplicate_rows(df)) == {"total": 5, "distinct": 3, "duplicates": 2}
    got = one(op.column_profile(df))
    assert (got["nulls"], got["nans"], got["distinct"]) == (1, 2, 3)


def test_empty_and_columnless(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert one(op.null_counts(empty)) == {"a": 0, "b": 0}
    assert one(op.duplicate_rows(empty)) == {"total": 0, "distinct": 0, "duplicates": 0}
    assert one(op.recurrence(empty, "a")) == {"min_rows": None, "max_rows": None, "avg_rows": None, "keys": 0, "no_recurrence": None}
    assert op.top_key(empty, "a").count() == 0 and op.share_of_total(empty, "a").count() == 0
    bare = spark.range(3).select()
    assert one(op.all_null_rows(bare))["n"] == 0 and op.column_profile(bare).count() == 0


def test_all_null_rows(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, "x")], "a int, b string")
    assert one(op.all_null_rows(df))["n"] == 1


def test_arrays_and_maps_do_not_break_the_profile(spark):
    df = spark.createDataFrame([([1.0], {"a": 1}, "x.y"), ([1.0], None, None)], "v array<float>, m map<string,int>, `odd.name` string")
    got = {r["column"]: r for r in op.column_profile(df).collect()}
    assert got["v"]["distinct"] == 1 and got["m"]["distinct"] is None and got["odd.name"]["nulls"] == 1
    assert op.describe_numeric(df).count() == 0


def test_quartiles(spark):
    df = spark.range(1, 101).selectExpr("cast(id as double) x", "'s' s")
    exact, approx = (one(op.describe_numeric(df, quartiles=q)) for q in ("exact", "approx"))
    assert exact == approx and (exact["p25"], exact["p50"], exact["p75"], exact["n"]) == (25.0, 50.0, 75.0, 100)


def test_join_report_keeps_unmatched_and_null_keys(spark):
    fact = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    assert op.category_report(fact, dim, "k", "name").collect() == [(None, 2), ("one", 2)]
    double = spark.createDataFrame([(1, "one"), (1, "uno")], "k int, name string")
    assert {tuple(r) for r in op.category_report(fact, double, "k", "name").collect()} == {("one", 2), ("uno", 2), (None, 2)}


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k int")
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, name string")
    assert op.orphans(child, parent, "k").collect() == [(9,)]
    assert op.matched(child, parent, "k").count() == 2
    assert one(op.orphan_summary(child, parent, "k")) == {"rows": 4, "matched": 2, "orphans": 1, "null_keys": 1}
    assert op.top_key_check(child, parent, "k", ["name"]).collect() == [(1, 2, True, "a")]


def test_top_key_ties_and_missing_parent(spark):
    child = spark.createDataFrame([(5,), (3,), (3,), (5,), (None,), (None,), (None,)], "k int")
    assert op.top_key(child, "k").collect() == [(3, 2)]
    parent = spark.createDataFrame([(5, "x")], "k int, name string")
    assert op.top_key_check(child, parent, "k", ["name"]).collect() == [(3, 2, False, None)]


def test_shares_and_recurrence(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert op.share_of_total(df, "s").collect() == [("a", 2, 66.67), (None, 1, 33.33)]
    assert one(op.recurrence(df, "s"))["no_recurrence"] is False
    assert one(op.recurrence(df.distinct(), "s"))["no_recurrence"] is True


def test_prices_and_listing(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", -1.0), ("c", None), ("a", 2.0)], "s string, p double")
    assert op.nonpositive(df, "p").count() == 2
    assert op.listing(df, ["s", "p"], ["s"], ["p"]).collect() == [("a", 2.0), ("a", 0.0), ("b", -1.0), ("c", None)]


def test_days(spark):
    d = dt.datetime
    df = spark.createDataFrame([(d(2024, 1, 1, 23), d(2024, 1, 3, 1)), (d(2024, 1, 5), d(2024, 1, 3)), (d(2024, 1, 5), None)], "a timestamp, b timestamp_ntz")
    assert [r[0] for r in df.select(days_between("a", "b")).collect()] == [2, -2, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x", "y")], "a string, b string").select(days_between("a", "b")).collect()


def test_guards(spark):
    with pytest.raises(ValueError, match="unknown columns"):
        op.frequency(spark.range(1), "nope")
    with pytest.raises(ValueError, match="no table"):
        op.null_counts(None)


def test_reconcile_and_profile_all(spark):
    a, b = spark.range(3).toDF("x"), spark.range(2).toDF("x")
    assert op.reconcile(a, b, "t").collect() == [("t", 3, 2, False)]
    got = profile_all({"a": a, "b": b})
    assert {(r["table"], r["rows"], r["duplicates"]) for r in got["tables"].collect()} == {("a", 3, 0), ("b", 2, 0)}
    assert got["columns"].count() == 2


def test_exact_quantiles_of_odd_values(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, 0.0, -0.0, 1.5, rng.random() * 1e6, rng.gauss(0, 1), float("nan")]), rng.randrange(3), None) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "x double, `odd.name` int, none double")
    got = {(r["column"], r["point"]): r["value"] for r in op.exact_quantiles(df, ["x", "odd.name", "none"], [0.0, 0.25, 0.5, 0.999, 1.0]).collect()}
    for i, c in enumerate(["x", "odd.name", "none"]):
        values = sorted((r[i] for r in rows if r[i] is not None), key=lambda v: (v != v, v))
        for p in (0.0, 0.25, 0.5, 0.999, 1.0):
            want = values[max(0, -(-len(values) * int(p * 1000) // 1000) - 1)] if values else None
            assert got[c, p] == want or got[c, p] != got[c, p] and want != want, (c, p)
    assert {r["value"] for r in op.exact_quantiles(df.limit(0), ["x"], [0.5]).collect()} == {None}


def test_distinct_counts_each_way(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, None), (2, "b")], "k int, s string")
    want = {("k", 3), ("s", 3)}
    for how in ("together", "by_column", "approx"):
        assert {tuple(r) for r in op.distinct_counts(df, how=how).collect()} == want
        assert {tuple(r) for r in op.distinct_counts(df.limit(0), how=how).collect()} == {("k", 0), ("s", 0)}
    with pytest.raises(ValueError):
        op.distinct_counts(df, how="guess")


def test_strings_and_table_profile(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None)], "s string, n int")
    assert op.describe_strings(df).collect() == [("s", 3, "a", "b")]
    assert op.describe_strings(df.select("n")).count() == 0
    assert one(op.table_profile(df)) == {"rows": 4, "columns": 2, "duplicates": 1, "all_null": 1}
    assert one(op.table_profile(df.limit(0))) == {"rows": 0, "columns": 2, "duplicates": 0, "all_null": 0}
    assert one(op.table_profile(spark.range(3).select()))["all_null"] == 0


def test_grouped_report_by_mean(spark):
    df = spark.createDataFrame([("a", 1.005), ("a", 1.004), ("b", 9.123), ("c", 5.555), ("c", 5.0), ("c", 5.1)], "s string, p double")
    got = op.grouped_stats(df, "s", "p", order_by="avg_value", round_all=False).collect()
    assert [r["s"] for r in got] == ["b", "c", "a"] and [r["avg_value"] for r in got] == [9.12, 5.22, 1.0]
    assert got[0]["min_value"] == 9.123 and got[1]["max_value"] == 5.555
    assert [r["s"] for r in op.grouped_stats(df, "s", "p").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        op.grouped_stats(df, "s", "p", order_by="total")
