"""Property checks and brute-force checks of the neighbour operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import nearest
from kiln.operators import clean, density, encode, neighbours, outliers, select, silhouette


def test_fill_leaves_no_null(spark):
    rows = [(float(i) if i % 4 else None, "x" if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, s string")
    out = clean.fit_fill(df, "median").transform(df)
    assert out.where("a IS NULL OR s IS NULL").count() == 0


def test_clip_inside_bounds(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.standard_t(2, size=500)], "a double")
    p = outliers.fit_cap(df, ["a"], "iqr")
    lo, hi = p.bounds["a"]
    r = p.transform(df).agg(F.min("a"), F.max("a")).first()
    assert r[0] >= lo and r[1] <= hi


def test_one_hot_row_sum_at_most_one_and_frequency_range(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", None][i % 4]) for i in range(40)], "id long, c string")
    oh = encode.one_hot(df, "c", drop_first=False)
    sums = oh.select(sum(F.col(c) for c in oh.columns if c.startswith("c_")).alias("s")).collect()
    assert max(r["s"] for r in sums) <= 1
    fr = encode.frequency_encode(df, "c").where("c_freq IS NOT NULL").collect()
    assert all(0 < r["c_freq"] <= 1 for r in fr)


def test_corr_filter_leaves_no_kept_pair_above(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200)
    cols = {"a": x, "b": x * 2 + rng.normal(scale=0.01, size=200), "c": rng.normal(size=200),
            "d": -x + rng.normal(scale=0.01, size=200)}
    df = spark.createDataFrame([tuple(float(cols[k][i]) for k in "abcd") for i in range(200)],
                               "a double, b double, c double, d double")
    dropped = select.corr_filter_columns(df, list("abcd"), 0.95)
    assert dropped == ["b", "d"]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(120, 5))
    lab = rng.integers(0, 3, size=120)
    df = spark.createDataFrame([(i, pts[i].tolist(), int(lab[i])) for i in range(120)],
                               "id long, v array<double>, y int")
    got = {r["id"]: r["prediction"] for r in neighbours.knn_vote(df, df, 5, "id", "v", "y", exclude_self=True).collect()}
    for i in range(120):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        nn = sorted(range(120), key=lambda j: (d[j], j))[:5]
        votes = np.bincount(lab[nn], minlength=3)
        assert got[i] == float(np.argmax(votes))


def test_knn_multiple_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 2000)  # forces several blocks
    rng = np.random.default_rng(9)
    pts = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, pts[i].tolist(), i % 2) for i in range(80)], "id long, v array<double>, y int")
    cand = neighbours.knn_candidates(df, df, 3, "id", "id", "v", "y", exclude_self=True).collect()
    for i in range(0, 80, 9):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        want = sorted(range(80), key=lambda j: (d[j], j))[:3]
        assert [r["_tid"] for r in sorted((r for r in cand if r["_qid"] == i), key=lambda r: r["_rank"])] == want


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(10)
    pts = np.vstack([rng.normal(0, 1, (30, 2)), rng.normal(6, 1, (30, 2))])
    lab = np.array([0] * 30 + [1] * 30)
    df = spark.createDataFrame([(i, pts[i].tolist(), int(lab[i])) for i in range(60)], "id long, v array<double>, c int")
    got = silhouette.silhouette_exact(df, "id", "v", "c").first()["silhouette"]
    s = []
    for i in range(60):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1))
        own = lab == lab[i]
        a = d[own].sum() / (own.sum() - 1)
        b = d[~own].mean()
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(float(np.mean(s)), rel=1e-9)


def test_dbscan_two_blobs(spark):
    rng = np.random.default_rng(11)
    pts = np.vstack([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, pts[i].tolist()) for i in range(81)], "id long, v array<double>")
    out = {r["id"]: r["cluster"] for r in density.dbscan(df, "id", "v", eps=0.5, min_samples=5).collect()}
    assert out[80] == -1
    assert len({out[i] for i in range(40)}) == 1 and len({out[i] for i in range(40, 80)}) == 1
    assert out[0] != out[40]


def test_smote_balances_and_interpolates(spark):
    rows = [(i, float(i), 0) for i in range(20)] + [(100 + i, 50.0 + i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y int")
    out = neighbours.smote(df, "y", ["x"], "id", k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 20, 1: 20}
    syn = [r["x"] for r in out.where("y = 1").collect()]
    assert min(syn) >= 50.0 and max(syn) <= 54.0
