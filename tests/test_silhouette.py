"""M5 by cell bounds: equal to all pairs, far clusters left out, many passes and blocks, edge cases."""

import numpy as np
import pytest

from kiln.operators import silhouette as sil

SCHEMA = "id string, v array<double>, c int"


def frame(spark, points, labels):
    return spark.createDataFrame([(f"p{i}", p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels, strict=True))], SCHEMA)


def all_pairs(points, labels, power=1):
    scores = []
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1)) ** power
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == c].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    centres = rng.uniform(-50, 50, (12, 3))
    labels = np.repeat(np.arange(12), rng.integers(5, 60, 12))
    points = centres[labels] + rng.normal(0, 1, (len(labels), 3))
    # a cluster in two far parts, one of a single point and one of equal points
    points = np.vstack([points, rng.normal(-90, 1, (20, 3)), rng.normal(90, 1, (20, 3)), [[0.0, 0.0, 0.0]], np.full((6, 3), 7.5)])
    return points, np.concatenate([labels, np.full(40, 12), [13], np.full(6, 14)])


@pytest.mark.parametrize("metric,power", [("euclidean", 1), ("squared", 2)])
def test_equals_all_pairs(spark, blobs, metric, power):
    got = sil.silhouette(frame(spark, *blobs), "id", "v", "c", metric).first()
    assert got["n_clusters"] == 15
    assert got["silhouette"] == pytest.approx(all_pairs(*blobs, power), abs=1e-9)


def test_passes_blocks_and_chunks_change_nothing(spark, blobs, monkeypatch):
    for name, value in (("CELL_BYTES", 600), ("BLOCK_BYTES", 400), ("POINT_ROWS", 16)):
        monkeypatch.setattr(sil, name, value)
    df = frame(spark, *blobs)
    assert sil.silhouette(df, "id", "v", "c").first()["silhouette"] == pytest.approx(all_pairs(*blobs), abs=1e-9)
    assert sil.silhouette(df, "id", "v", "c", "squared").first()["silhouette"] == pytest.approx(all_pairs(*blobs, 2), abs=1e-9)


def test_far_clusters_are_not_scanned(spark, blobs, monkeypatch):
    kept = {}
    save = sil.saved

    def watch(df, name="step", schema=None):
        kept[name] = save(df, name, schema)
        return kept[name]

    monkeypatch.setattr(sil, "saved", watch)
    sil.silhouette(frame(spark, *blobs), "id", "v", "c").first()
    n = len(blobs[1])
    assert 2 * n <= kept["wanted"].count() < 4 * n  # own and nearest, of 15 clusters


def test_no_scan_with_squared_distances(spark, blobs):
    plan = sil.silhouette(frame(spark, *blobs), "id", "v", "c", "squared")._jdf.queryExecution().toString()
    assert "CoGroup" not in plan


def test_edge_cases(spark):
    empty = sil.silhouette(spark.createDataFrame([], SCHEMA), "id", "v", "c").first()
    assert (empty["silhouette"], empty["n_clusters"]) == (None, 0)
    one = sil.silhouette(frame(spark, np.eye(3), [0, 0, 0]), "id", "v", "c").first()
    assert (one["silhouette"], one["n_clusters"]) == (0.0, 1)
    rows = [("a", [0.0], 0), ("b", [1.0], 0), ("c", [9.0], 1), (None, [5.0], 1), ("d", None, 1), ("e", [4.0], None)]
    got = sil.silhouette(spark.createDataFrame(rows, SCHEMA), "id", "v", "c").first()
    assert got["silhouette"] == pytest.approx((8 / 9 + 7 / 8 + 0) / 3) and got["n_clusters"] == 2
    same = sil.silhouette(frame(spark, np.ones((8, 2)), [0, 1] * 4), "id", "v", "c").first()
    assert same["silhouette"] == pytest.approx(0.0)
    with pytest.raises(ValueError, match="metric"):
        sil.silhouette(frame(spark, np.eye(2), [0, 1]), "id", "v", "c", "cosine")


def test_distance_sums_are_dealt_by_work_not_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, p.tolist(), int(i % 3)) for i, p in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    plan = sil.silhouette(df, "id", "v", "c")._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan  # Spark would join the small partitions to one task


def test_several_labellings_share_one_scan(spark, blobs, monkeypatch):
    monkeypatch.setattr(sil, "PAIR_ROWS", 64)
    monkeypatch.setattr(sil, "PAIR_TILE", 16)
    points, labels = blobs
    points = np.vstack([points, points[:30]])  # equal rows
    labels = np.concatenate([labels, labels[:30]])
    rng = np.random.default_rng(2)
    several = [labels, labels % 3, rng.integers(0, 9, len(labels)), np.zeros(len(labels), int), (np.arange(len(labels)) == 5).astype(int)]
    rows = [(f"p{i}", p.tolist(), *[int(c[i]) for c in several]) for i, p in enumerate(points)]
    rows += [(None, [0.0] * 3, 0, 0, 0, 0, 0), ("x", None, 0, 0, 0, 0, 0), ("y", [0.0] * 3, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "id string, v array<double>, a int, b int, c int, d int, e int").repartition(4)
    met = []
    meet = sil._shared_sums
    monkeypatch.setattr(sil, "_shared_sums", lambda *a: met.append(1) or meet(*a))
    got = sil.silhouettes(df, "id", "v", list("abcde"))
    assert met == [1]
    assert [n for _, n in got] == [15, 3, 9, 1, 2] and got[3][0] == 0.0
    for i in (0, 1, 2, 4):
        assert got[i][0] == pytest.approx(all_pairs(points, several[i]), abs=1e-9)
    assert sil.silhouettes(df.limit(0), "id", "v", ["a", "b"]) == [(None, 0), (None, 0)]


def test_a_pair_of_rows_meets_once(blobs):
    points, labels = blobs
    order = np.argsort(labels, kind="stable")
    points, labels = points[order], labels[order]
    x, m = points[:200], points[200:]
    d = np.sqrt(((x[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))
    of_x, of_m = sil._meet(x, m, labels[:200], labels[200:], np.eye(15), True)
    assert of_x == pytest.approx(d @ np.eye(15)[labels[200:]], abs=1e-6)
    assert of_m == pytest.approx(d.T @ np.eye(15)[labels[:200]], abs=1e-6)
