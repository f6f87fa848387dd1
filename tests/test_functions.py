"""Distributed primitives against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import ordering, selection
from kiln.functions.exprs import kurt_sample, pair_corr, skew_sample


def _frame(spark, values, groups=None):
    rows = [(i, float(v) if v is not None else None, (groups[i] if groups else "g")) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, x double, g string")


@pytest.mark.parametrize("cap", [2_000_000, 7])  # 7 forces the refining loop
def test_exact_quantiles_match_numpy(spark, cap):
    rng = np.random.default_rng(1)
    vals = list(np.round(rng.lognormal(size=3000), 3)) + [5.0] * 400 + [None] * 50
    df = _frame(spark, vals)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in selection.exact_quantiles(df, ["x"], probs, cap=cap).collect()}
    arr = np.array([v for v in vals if v is not None])
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(arr, p * 100), rel=1e-12, abs=1e-12)


def test_exact_quantiles_grouped_with_hot_group(spark):
    rng = np.random.default_rng(2)
    n = 4000
    groups = ["hot" if i % 3 else f"c{i % 7}" for i in range(n)]  # one key holds 2/3 of the rows
    vals = list(rng.normal(size=n))
    df = _frame(spark, vals, groups)
    res = selection.exact_quantiles(df, ["x"], [0.25, 0.5], by=["g"]).collect()
    for r in res:
        arr = np.array([v for v, g in zip(vals, groups) if g == r["g"]])
        assert r["value"] == pytest.approx(np.percentile(arr, r["p"] * 100), abs=1e-12)


def test_row_index_multi_bucket(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 100)
    rng = np.random.default_rng(3)
    keys = rng.permutation(1000).tolist()
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    out = ordering.row_index(df, ["k"], "idx").collect()
    assert sorted((r["k"], r["idx"]) for r in out) == [(i, i) for i in range(1000)]


def test_lag_pairs_and_running_sum(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 50)
    df = spark.createDataFrame([(i, float(i * i)) for i in range(500)], "k long, v double")
    lag = {r["k"]: r["prev_v"] for r in ordering.lag_pairs(df, "k", ["v"]).collect()}
    assert lag[0] is None and all(lag[i] == float((i - 1) ** 2) for i in range(1, 500))
    rs = {r["k"]: r["cs"] for r in ordering.running_sum(df, "k", "v", "cs", inclusive=False).collect()}
    acc = 0.0
    for i in range(500):
        assert rs[i] == acc
        acc += i * i


def test_sample_corrected_moments(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    df = _frame(spark, vals)
    r = df.agg(skew_sample(F.col("x")).alias("s"), kurt_sample(F.col("x")).alias("k")).first()
    import pandas as pd
    s = pd.Series(vals)
    assert r["s"] == pytest.approx(s.skew(), rel=1e-9)
    assert r["k"] == pytest.approx(s.kurt(), rel=1e-9)


def test_moments_small_and_constant(spark):
    two = _frame(spark, [1.0, 2.0]).agg(skew_sample(F.col("x")).alias("s"), kurt_sample(F.col("x")).alias("k")).first()
    assert two["s"] is None and two["k"] is None
    three = _frame(spark, [1.0, 2.0, 4.0]).agg(skew_sample(F.col("x")).alias("s"),
                                                kurt_sample(F.col("x")).alias("k")).first()
    assert three["s"] is not None and three["k"] is None
    const = _frame(spark, [3.0] * 5).agg(skew_sample(F.col("x")).alias("s")).first()
    assert const["s"] == 0.0


def test_pair_corr_constant_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert df.agg(pair_corr(F.col("a"), F.col("b")).alias("r")).first()["r"] is None


def test_wide_correlation_gram_path_matches_expressions(spark, monkeypatch):
    from kiln.operators import bivariate
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 4))
    rows = []
    for r in range(300):
        v = [float(base[r, 0]), float(base[r, 0] * 2 + base[r, 1]), float(base[r, 2]) if r % 5 else None,
             float(1e6 + base[r, 3]), 7.0]
        rows.append(tuple(v))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    cols = list("abcde")
    want = {(r["col_a"], r["col_b"]): r["r"] for r in bivariate.corr_long(df, cols).collect()}
    monkeypatch.setattr(bivariate, "WIDE_CORR", 2)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in bivariate.corr_long(df, cols).collect()}
    assert set(want) == set(got)
    for key, v in want.items():
        if v is None:
            assert got[key] is None, key
        else:
            assert got[key] == pytest.approx(v, abs=1e-9), key


def _np_quantiles(vals, probs):
    # brute force: sort, then linear interpolation between the floor and ceil ranks
    arr = sorted(v for v in vals if v is not None and v == v)
    out = {}
    for p in probs:
        pos = p * (len(arr) - 1)
        k0 = int(pos // 1)
        k1 = min(k0 + 1, len(arr) - 1)
        frac = pos - k0
        out[p] = arr[k0] if frac == 0 else arr[k0] + frac * (arr[k1] - arr[k0])
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 37, 30_000])
def test_global_quantiles_two_job_path(spark, n):
    rng = np.random.default_rng(n)
    # a third of the rows share one hot value; the rest are spread, with ties and infinities
    vals = [7.5 if i % 3 == 0 else float(np.round(rng.normal(scale=10), 2)) for i in range(n)]
    if n > 5:
        vals[1], vals[2] = float("inf"), float("-inf")
    df = spark.createDataFrame([(v, v * 2) for v in vals], "x double, y double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = selection.global_quantiles(df, ["x", "y"], probs)
    assert got is not None
    for c, mult in (("x", 1), ("y", 2)):
        want = _np_quantiles([v * mult for v in vals], probs)
        for p in probs:
            w = want[p]
            assert got[c][p] == w or (w != w and got[c][p] != got[c][p]) or got[c][p] == pytest.approx(w, rel=1e-12)


def test_global_quantiles_null_column_and_cap_fallback(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(50)], "x double, y double")
    got = selection.quantile_dict(df, ["x", "y"], [0.5])
    assert got["x"] == {} and got["y"][0.5] == pytest.approx(24.5)
    # a cap below the bracket bound declines, and the distributed selector answers instead
    assert selection.global_quantiles(df, ["y"], [0.5], cap=3) is None
    res = selection.exact_quantiles(df, ["y"], [0.5], cap=3).collect()
    assert res[0]["value"] == pytest.approx(24.5)


@pytest.mark.parametrize("n,k", [(1, 0), (10, 3), (3000, 0), (3000, 599), (30_000, 5999), (30_000, 29_999)])
def test_global_kth_matches_sorted(spark, n, k):
    rng = np.random.default_rng(n + k)
    vals = [float(v) for v in np.round(rng.uniform(size=n), 3)]  # many ties
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = selection.global_kth(df, "x", k, (k + 1) / n)
    assert got is not None
    srt = sorted(vals)
    v = srt[k]
    assert got == (v, sum(1 for a in vals if a < v), sum(1 for a in vals if a == v))


def test_two_job_paths_decline_wide_requests(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_SKETCHES", 1)
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(100)], "x double, y double")
    assert selection.global_quantiles(df, ["x", "y"], [0.5]) is None
    # the grouped selector answers instead, with the same values
    got = selection.quantile_dict(df, ["x", "y"], [0.5])
    assert got == {"x": {0.5: 49.5}, "y": {0.5: -49.5}}
    two = [(F.col("x") < 50, 10, 0.2), (F.col("x") >= 50, 10, 0.2)]
    assert selection.kth_many(df, "x", two) is None


def test_row_index_over_many_ranges_of_any_type(spark, monkeypatch):
    import datetime as dt

    from kiln.functions import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 40)
    rows = [(f"w{i % 7}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i % 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t string, d timestamp_ntz, k long").repartition(6)
    for first in ("t", "d"):
        got = [r["k"] for r in sorted(ordering.row_index(df, [first, "k"], "i").collect(), key=lambda r: r["i"])]
        assert got == [r[2] for r in sorted(rows, key=lambda r: (r[0] if first == "t" else r[1], r[2]))]
