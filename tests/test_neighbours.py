"""Nearest rows, density clusters and components against brute force, over many small blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import graph, nearest
from kiln.operators import density


def points(n=300, dim=3, seed=1):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(4 * (i % 4), 1) * 64) / 64 for _ in range(dim)]) for i in range(n)]  # exact sums
    return rows + [(n + i, [1.0] * dim) for i in range(120)]  # a third or so in one place


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("text", [False, True])
def test_nearest_rows_equal_brute_force_over_blocks(spark, monkeypatch, metric, text):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 20 * (3 * 8 + 16))  # 20 rows a block
    monkeypatch.setattr(nearest, "QUERY_ROWS", 32)
    rows = points()
    name = (lambda i: f"id {i:05d}") if text else (lambda i: i)
    df = spark.createDataFrame([(name(i), v, float(i % 5)) for i, v in rows] + [(name(9999), None, 1.0)], f"_tid {'string' if text else 'bigint'}, _tv array<double>, _tlabel double")
    q = df.select(F.col("_tid").alias("_qid"), F.col("_tv").alias("_qv"))
    got = {}
    for r in nearest.nearest_rows(q, df, 4, True, metric).collect():
        got.setdefault(r["_qid"], []).append((r["_rank"], r["_tid"], round(r["_dist"], 9)))
    dist = (lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))) if metric == "manhattan" else math.dist
    for i, v in rows:
        want = sorted((round(dist(v, w), 9), name(j)) for j, w in rows if j != i)[:4]
        assert [(t, d) for _, t, d in sorted(got[name(i)])] == [(t, d) for d, t in want]
    assert name(9999) not in got


def test_nearest_rows_visit_few_blocks(spark, monkeypatch):
    """Rows of four distant groups: queries and blocks that meet grow with the rows, not their square."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 50 * (2 * 8 + 16))
    r = random.Random(4)
    rows = [(i, [1000.0 * (i % 8) + r.random(), r.random()], 0.0) for i in range(1600)]
    df = spark.createDataFrame(rows, "_tid bigint, _tv array<double>, _tlabel double")
    visits = []
    meet = nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda v, *rest: (visits.append(v.select(F.sum(F.size("_blocks"))).first()[0]), meet(v, *rest))[1])
    assert nearest.nearest_rows(df.select(F.col("_tid").alias("_qid"), F.col("_tv").alias("_qv")), df, 3).count() == 4800
    assert sum(visits) < 0.35 * 1600 * 32  # 32 blocks


def test_nearest_rows_of_nothing(spark):
    df = spark.createDataFrame([], "_tid bigint, _tv array<double>, _tlabel double")
    q = spark.createDataFrame([(1, [0.0])], "_qid bigint, _qv array<double>")
    assert nearest.nearest_rows(q, df, 2).collect() == []
    one = spark.createDataFrame([(1, [2.0], 3.0)], "_tid bigint, _tv array<double>, _tlabel double")
    assert [tuple(x) for x in nearest.nearest_rows(q, one, 2).collect()] == [(1, 1, 2.0, 3.0, 1)]
    assert nearest.nearest_rows(q, one, 2, exclude_self=True).collect() == []


def brute_dbscan(rows, eps, least):
    near = {i: [j for j, w in rows if math.dist(v, w) <= eps] for i, v in rows}
    core = sorted(i for i in near if len(near[i]) >= least)
    label, n = {}, 0
    for i in core:
        if i in label:
            continue
        stack = [i]
        label[i] = n
        while stack:
            for j in near[stack.pop()]:
                if len(near[j]) >= least and j not in label:
                    label[j] = n
                    stack.append(j)
        n += 1
    return {i: label[i] if i in label else min((label[j] for j in near[i] if j in label and len(near[j]) >= least), default=-1) for i, _ in rows}


@pytest.mark.parametrize("dim, eps", [(1, 0.05), (2, 0.35)])
def test_dbscan_equals_brute_force(spark, monkeypatch, dim, eps):
    monkeypatch.setattr(density, "CELL_POINTS", 64)
    monkeypatch.setattr(density, "CHUNK", 48)
    r = random.Random(dim)
    rows = [(f"p{i:04d}", [round(r.gauss(3 * (i % 3), 0.8), 2) for _ in range(dim)]) for i in range(220)]
    rows += [(f"q{i:04d}", [0.5] * dim) for i in range(80)] + [(f"r{i:04d}", [10 + 0.9 * eps * i] + [0.0] * (dim - 1)) for i in range(60)]
    df = spark.createDataFrame(rows + [("null", None), ("nan", [float("nan")] * dim)], "id string, v array<double>").repartition(3)
    got = {x["id"]: x["cluster"] for x in density.dbscan(df, "id", "v", eps, 3).collect()}
    assert got.pop("null") == -1 and got.pop("nan") == -1
    assert got == brute_dbscan(rows, eps, 3)


def test_dbscan_of_nothing(spark):
    df = spark.createDataFrame([], "id string, x double, y double")
    assert density.dbscan(df, "id", ["x", "y"]).collect() == []


def test_components_of_paths_stars_and_lone_nodes(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 500 + k) for k in range(1, 80)] + [(300, 300), (7, 3), (3, 7)]
    nodes = [*range(201), *range(500, 580), 300, 900]
    random.Random(0).shuffle(nodes)
    got = graph.connected_components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r["node"]: r["root"] for r in got.collect()}
    assert len({got[k] for k in range(201)}) == 1 and len({got[500 + k] for k in range(80)}) == 1
    assert got[300] == 300 and got[900] == 900 and len(set(got.values())) == 4 and len(got) == len(nodes)
    assert np.isin(list(got.values()), nodes).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("dim", [2, 20])
def test_nearest_rows_of_equal_vectors_and_of_ids_that_repeat(spark, monkeypatch, metric, dim):
    """Few distinct vectors with many rows each: searched once per vector, and no copy meets all others."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 16 * (dim * 8 + 16))
    r = random.Random(dim)
    kinds = [[float(r.randrange(-3, 4)) for _ in range(dim)] for _ in range(30)]
    rows = [(i // 2 if i < 20 else i, kinds[r.randrange(30)], float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "_tid bigint, _tv array<double>, _tlabel double")
    searched = []
    search = nearest._search
    monkeypatch.setattr(nearest, "_search", lambda q, t, *rest: (searched.append((q.count(), t.count())), search(q, t, *rest))[1])
    got = {}
    for x in nearest.nearest_rows(df.select(F.col("_tid").alias("_qid"), F.col("_tv").alias("_qv")), df, 3, True, metric).collect():
        got.setdefault(x["_qid"], []).append((round(x["_dist"], 9), x["_tid"]))
    dist = (lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))) if metric == "manhattan" else math.dist
    want = {}
    for i, v, _ in rows:
        want.setdefault(i, []).extend(sorted((round(dist(v, w), 9), j) for j, w, _ in rows if j != i)[:3])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x)[:3] for i, x in want.items()}
    assert searched[0][0] <= 30 + 20 and searched[0][1] <= 30 * 8


def test_nearest_rows_of_few_dimensions_use_small_blocks(spark, monkeypatch):
    """A row meets about the root of the rows, not all those that fit into one task's memory."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 8)
    r = random.Random(5)
    df = spark.createDataFrame([(i, [r.random() * 1000], 0.0) for i in range(2000)], "_tid bigint, _tv array<double>, _tlabel double")
    met = []
    meet = nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda v, b, *rest: (met.append((v.select(F.sum(F.size("_blocks"))).first()[0], b.select("_block").distinct().count())), meet(v, b, *rest))[1])
    nearest.nearest_rows(df.select(F.col("_tid").alias("_qid"), F.col("_tv").alias("_qv")), df, 3, True).count()
    assert met[0][1] >= 15 and sum(v for v, _ in met) <= 4 * 2000


def test_package_is_shipped_once_by_threads(spark, monkeypatch):
    import threading
    import time

    from kiln import session
    calls, gate = [], threading.Barrier(6)
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: (time.sleep(0.3), calls.append(path)))
    threads = [threading.Thread(target=lambda: (gate.wait(), session.ship_package(spark))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1


def test_nearest_rows_without_a_label_or_a_number(spark):
    ref = spark.createDataFrame([(1, [0.0], None), (2, [1.0], 3.0), (3, [5.0], 4.0)], "_tid bigint, _tv array<double>, _tlabel double")
    q = spark.createDataFrame([(9, [0.1])], "_qid bigint, _qv array<double>")
    got = nearest.nearest_rows(q, ref, 2).orderBy("_rank").collect()
    assert [x["_tid"] for x in got] == [1, 2] and math.isnan(got[0]["_tlabel"]) and got[1]["_tlabel"] == 3.0
    more = ref.unionByName(spark.createDataFrame([(4, [None], 1.0)], ref.schema))
    assert nearest.nearest_rows(q, more, 2).collect() == []  # as ever: no bounds in a block with a row that is no point


@pytest.mark.parametrize("shift, spread", [(0.0, 0.2), (50.0, 0.2), (1e9, 1.0), (0.0, 30.0)])
def test_steps_of_wide_sums_keep_every_near_row(shift, spread):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(3000, 64)) * 0.2 + shift
    q = np.vstack([rng.normal(size=(90, 64)) * spread + shift, m[:10]])  # within the block, outside of it, equal rows
    rough = nearest._Rough(m, "manhattan")
    assert rough.step > 0  # sums of 16 bits
    exact = np.abs(q[:, None, :] - m[None, :, :]).sum(axis=2)
    tau = np.partition(exact, 5, axis=1)[:, 5]
    keys, edge, error = rough.keys(q, tau)
    assert (keys[exact <= tau[:, None]] <= np.repeat(edge, (exact <= tau[:, None]).sum(axis=1))).all()
    apart = exact / rough.scale / rough.step - keys  # per query the same, but for the error
    assert (apart.max(axis=1) - apart.min(axis=1) <= 2 * error).all()
    if shift < 1e9 and spread < 1:
        assert ((keys <= edge[:, None]).sum(axis=1) < 60).all()  # few rows are left for exact distances


def test_wide_sums_find_the_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 90 * (24 * 8 + 16))
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(np.vstack([rng.normal(size=(280, 24)), np.full((20, 24), 3.0)]))]
    df = spark.createDataFrame(rows, "_tid bigint, _tv array<double>, _tlabel double")
    got = {}
    for r in nearest.nearest_rows(df.select(F.col("_tid").alias("_qid"), F.col("_tv").alias("_qv")), df, 5, True, "manhattan").collect():
        got.setdefault(r["_qid"], []).append((r["_rank"], r["_tid"]))
    for i, v, _ in rows:
        want = sorted((round(sum(abs(x - y) for x, y in zip(v, w, strict=True)), 9), j) for j, w, _ in rows if j != i)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
