"""Fits of k-means that share their passes, held against the estimator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from kiln.operators import unsupervised


@pytest.fixture(scope="module")
def vec(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>").repartition(3, "id")
    return df.select("id", array_to_vector("v").alias("features")).cache()


def test_fits_refined_together_equal_separate_fits(vec, monkeypatch):
    want = {k: min(KMeans(k=k, seed=42 + s, featuresCol="features", maxIter=300).fit(vec).summary.trainingCost for s in range(3)) for k in (2, 3, 4)}
    used = []

    def estimator(**kw):
        used.append(kw["maxIter"])
        return KMeans(**kw)

    monkeypatch.setattr(unsupervised, "KMeans", estimator)
    found = unsupervised.kmeans_models(vec, "id", 2, 4, n_init=3)
    assert {k: cost for k, _, cost, _ in found} == pytest.approx(want, rel=1e-9)
    assert used == [0] * 9  # only starts are found one by one


def test_an_empty_centre_stays(spark):
    points = spark.createDataFrame([([0.0],), ([1.0],)], "_v array<double>")
    [(centres, cost)] = unsupervised.lloyd(points, [np.array([[0.0], [99.0]])])
    assert centres.tolist() == [[0.5], [99.0]] and cost == pytest.approx(0.5)


def test_all_fits_meet_a_row_together():
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(size=(700, 3)), [[0.5, 0.0, 0.0]]])
    fits = [(i, rng.normal(size=(k, 3))) for i, k in enumerate((4, 2, 4, 3))] + [(4, np.array([[0.0] * 3, [1.0, 0.0, 0.0], [9.0] * 3]))]  # a tie: the smallest centre

    class Held:
        value = fits

    batch = pa.RecordBatch.from_arrays([pa.array(points.tolist(), pa.list_(pa.float64()))], names=["_v"])
    [out] = unsupervised._assign(Held)(iter([batch]))
    for f, c in fits:
        away = ((points[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        near = away.argmin(axis=1)
        rows = [r for r in out.to_pylist() if r["fit"] == f]
        assert sum(r["cost"] for r in rows) == pytest.approx(away.min(axis=1).sum())
        assert {r["centre"]: r["n"] for r in rows if r["n"]} == {i: float((near == i).sum()) for i in np.unique(near)}
        for r in rows:
            if r["n"]:
                assert r["total"] == pytest.approx(points[near == r["centre"]].sum(axis=0))


def test_the_silhouettes_of_all_k_share_one_scan(vec, monkeypatch):
    asked = []
    scores = unsupervised.silhouettes
    monkeypatch.setattr(unsupervised, "silhouettes", lambda *a: asked.append(a[3]) or scores(*a))
    found = unsupervised.kmeans_models(vec, "id", 2, 4, n_init=1)
    assert asked == [["_k2", "_k3", "_k4"]]
    for k, centres, _, score in found:
        lab = vec.select("id", vector_to_array("features").alias("v")).withColumn("c", unsupervised.nearest_centre(F.col("v"), centres))
        assert score == pytest.approx(unsupervised.silhouette_exact(lab, "id", "v", "c").first()["silhouette"], abs=1e-9)
