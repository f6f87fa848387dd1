"""Clustering in the space of one projection, held against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kiln.operators import unsupervised
from kiln.plans.prepare import run_unsupervised


def blobs(spark, centres, per=40):
    rng = np.random.default_rng(3)
    rows = []
    for c, (x, y) in enumerate(centres):
        for _ in range(per):
            a, b = rng.normal(x, 0.1), rng.normal(y, 0.1)
            rows.append((f"r{len(rows)}", float(a), float(b), float(a + b + rng.normal(0, 0.01)), c))
    return spark.createDataFrame(rows, "id string, a double, b double, s double, truth int")


def test_component_space_equals_numpy(spark):
    df = blobs(spark, [(0, 0), (5, 1), (1, 6)])
    space = unsupervised.component_space(df, ["a", "b", "s"], "id")
    local = df.toPandas().set_index("id")
    z = local[["a", "b", "s"]].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    _, sing, axes = np.linalg.svd(z, full_matrices=False)
    shares = sing ** 2 / (sing ** 2).sum()
    report = space.report.orderBy("component").toPandas()
    assert np.allclose(report["explained"], shares) and space.chosen == 2
    axes = axes[:2] * np.sign([ax[np.abs(ax).argmax()] for ax in axes[:2]])[:, None]
    got = space.rows.select("id", "pc1", "pc2", vector_to_array("features").alias("v")).toPandas().set_index("id").loc[local.index]
    assert np.allclose(got[["pc1", "pc2"]], z @ axes.T) and np.allclose(np.stack(got["v"]), z @ axes.T)


def test_best_clusters_reach_the_view(spark):
    df = blobs(spark, [(0, 0), (5, 1), (1, 6)])
    run = unsupervised.cluster_components(df, ["a", "b", "s"], "id", k_max=4, eps=0.3, n_init=2)
    board = run.leaderboard.collect()
    assert [r["Model"] for r in board].count("KMeans") == 3 and board[0]["n_clusters"] == 3
    assert run.silhouette == max(r["silhouette"] for r in board) and run.silhouette > 0.9
    pairs = run.view.join(df, "id").select("cluster", "truth").distinct().where("cluster >= 0").collect()
    assert len(pairs) == 3 and len({p["cluster"] for p in pairs}) == 3


def test_one_density_cluster_has_no_score(spark):
    df = blobs(spark, [(0, 0)], per=60)
    run = unsupervised.cluster_components(df, ["a", "b", "s"], "id", k_max=2, eps=50.0, n_init=1)
    density = [r for r in run.leaderboard.collect() if r["Model"] == "DBSCAN"][0]
    assert density["n_clusters"] == 1 and density["silhouette"] is None and run.best == "KMeans (k=2)"


def test_small_tables(spark):
    df = blobs(spark, [(0, 0)], per=2)
    with pytest.raises(ValueError):
        unsupervised.component_space(df, ["a", "b"], "id")
    assert run_unsupervised(df, "id") is None
