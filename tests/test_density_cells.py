"""Dense cells are linked by few points, with the clusters of brute force."""

import numpy as np
import pytest

from kiln.operators import density


@pytest.mark.parametrize("gap,clusters", [(0.99, 1), (1.01, 2)])
def test_close_inner_points_link_cells(spark, gap, clusters):
    # in each dimension other points of the cell lie farther out than the two that are within eps
    left = [(0.0, 0.3), (-0.5, 0.0), (-0.5, 0.6), (-0.02, 0.58), (-0.02, 0.02)]
    rows = [(f"p{i}", x, y) for i, (x, y) in enumerate(left + [(gap - x, y) for x, y in left[:1]] + [(gap + 0.4, 0.05), (gap + 0.4, 0.55)])]
    df = spark.createDataFrame(rows, "id string, x double, y double")
    got = {r["id"]: r["cluster"] for r in density.dbscan(df, "id", ["x", "y"], eps=1.0, min_samples=2).collect()}
    pts = np.array([r[1:] for r in rows])
    near = ((pts[:, None] - pts[None]) ** 2).sum(axis=2) <= 1
    reach = np.linalg.matrix_power(near.astype(int), len(pts)) > 0
    assert len({tuple(r) for r in reach}) == clusters == len(set(got.values())) and -1 not in got.values()


def test_dense_cells_are_linked_by_few_points(spark, monkeypatch):
    met = []
    meet = density._meet

    def watch(queries, rows, work, schema):
        met.append(rows.count())
        return meet(queries, rows, work, schema)

    monkeypatch.setattr(density, "_meet", watch)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 2, (4000, 2)))], "id int, x double, y double")
    assert density.dbscan(df, "id", ["x", "y"], eps=1.0).select("cluster").distinct().count() == 1
    assert met[1] <= 9 * 4  # the outermost points of nine cells; before, all 4000


@pytest.mark.parametrize("dim,seed", [(2, 0), (3, 1)])
def test_components_of_dense_cells_equal_brute_force(spark, dim, seed):
    from tests.test_neighbours import brute_dbscan
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(c, 0.12, (90, dim)) for c in rng.uniform(0, 1.6, (5, dim))])
    rows = [(f"k{i:03d}", p.tolist()) for i, p in enumerate(pts)]
    for eps in (0.08, 0.16):
        got = {r["id"]: r["cluster"] for r in density.dbscan(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", eps, 4).collect()}
        assert got == brute_dbscan(rows, eps, 4)
