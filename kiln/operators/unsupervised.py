"""M: the unsupervised branch (feature matrix, PCA, k-means sweep, DBSCAN, leaderboard).

PCA reduces the data to a k x k covariance on the driver (k = number of
features, small); k-means starts come from ``pyspark.ml`` and are refined together, one pass a step
for all of them; silhouettes are exact (``silhouette.silhouettes``).
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import finite, is_numeric, is_string, is_temporal, q
from kiln.functions.nearest import vectors
from kiln.operators.clean import all_null_columns, column_medians
from kiln.operators.encode import MAX_ONE_HOT_LEVELS, epoch_seconds, one_hot_exprs
from kiln.operators.density import dbscan
from kiln.operators.scale import STANDARD, fit_scaler
from kiln.operators.select import zero_variance_columns
from kiln.operators.silhouette import silhouette_exact, silhouettes
from kiln.session import saved, ship_package

MIN_ROWS = 10
MIN_FEATURES = 2
PCA_VARIANCE = 0.95
FITS_AT_ONCE = 8
#: The estimator's settings.
KMEANS_ITERATIONS = 300
KMEANS_TOL = 1e-4
#: Rows that meet the centres of all fits at once: the scores stay in a core's cache.
ASSIGN_ROWS = 512


def _text_modes_and_levels(df: DataFrame, texts: list[str]) -> dict[str, tuple]:
    """``{column: (mode, sorted levels)}`` for all text columns from one frequency table.

    The first job returns one row per column (level count and mode, the smallest value among
    the most frequent); levels are collected only after every count is checked against
    ``MAX_ONE_HOT_LEVELS``.
    """
    if not texts:
        return {}
    wide = df.select(*[F.col(q(c)).cast("string").alias(c) for c in texts])
    ft = (wide.unpivot([], texts, "column_name", "value").where(F.col("value").isNotNull())
          .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    stats = {r["column_name"]: r for r in ft.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("nu"),
        F.min(F.struct(F.negative(F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("m")).collect()}
    for c, r in stats.items():
        if r["nu"] > MAX_ONE_HOT_LEVELS:
            raise ValueError(f"{c} has {r['nu']} levels, more than {MAX_ONE_HOT_LEVELS}: use sparse.sparse_matrix")
    levels: dict[str, list[str]] = {c: [] for c in texts}
    for r in ft.select("column_name", "value").collect():
        levels[r["column_name"]].append(r["value"])
    return {c: (stats[c]["m"]["v"] if c in stats else None, sorted(levels[c])) for c in texts}


def unsupervised_matrix(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """M1: all-null columns dropped; datetimes -> seconds; numeric median fill; text mode fill +
    one-hot of every level (first level dropped); NaN / inf / missing -> 0; zero-variance columns
    dropped."""
    keep = [c for c in df.columns if c != id_col]
    dead = set(all_null_columns(df.select(*keep))) if keep else set()
    cols = [c for c in keep if c not in dead]
    base = df.select(*([id_col] if id_col else []),
                     *[epoch_seconds(c, df.schema[c].dataType).alias(c) if is_temporal(df.schema[c].dataType)
                       else F.col(q(c)) for c in cols])
    nums = [c for c in cols if is_numeric(base.schema[c].dataType)]
    texts = [c for c in cols if is_string(base.schema[c].dataType)]
    med = column_medians(base, nums)
    sel = [F.col(q(id_col))] if id_col else []
    sel += [F.coalesce(finite(F.coalesce(F.col(q(c)).cast("double"), F.lit(med[c]))), F.lit(0.0)).alias(c)
            for c in nums]
    fitted = _text_modes_and_levels(base, texts)
    for c in texts:
        m, levels = fitted[c]
        base = base.withColumn(c, F.coalesce(F.col(q(c)), F.lit(m)))
        sel += [e.cast("double") for e in one_hot_exprs(c, levels, drop_first=True)] if levels else []
    mat = base.select(*sel)
    feats = [c for c in mat.columns if c != id_col]
    return mat.drop(*zero_variance_columns(mat, feats, fill_zero=True))


def standardised_vectors(df: DataFrame, features: list[str], id_col: str | None = None) -> DataFrame:
    p = fit_scaler(df, features, STANDARD)
    sc = p.transform(df.select(*([id_col] if id_col else []), *features))
    return VectorAssembler(inputCols=features, outputCol="features").transform(sc)


def pca_report(df: DataFrame, features: list[str], max_components: int = 10):
    """M2: explained and cumulative variance ratio per component; chosen count = first reaching
    0.95, clamped to [2, max]. Returns (report DataFrame, chosen k, fitted model)."""
    spark = df.sparkSession
    vec = standardised_vectors(df, features)
    full = PCA(k=len(features), inputCol="features", outputCol="pcs").fit(vec)
    ratios = full.explainedVariance.toArray().tolist()
    cum, rows = 0.0, []
    for i, r in enumerate(ratios):
        cum += r
        rows.append((i + 1, float(r), float(cum)))
    chosen = next((i + 1 for i, (_, _, c) in enumerate(rows) if c >= PCA_VARIANCE), len(rows))
    chosen = max(MIN_FEATURES, min(max_components, chosen, len(features)))
    rep = spark.createDataFrame(rows, "component int, explained double, cumulative double")
    model = PCA(k=chosen, inputCol="features", outputCol="pcs").fit(vec)
    return rep, chosen, model


def pca_2d_view(df: DataFrame, features: list[str], id_col: str, labels: DataFrame | None = None,
                n: int | None = None, seed: int = 42) -> DataFrame:
    """M7: first two components (sign fixed: largest loading positive) of all rows, or of a seeded
    sample of ``n``."""
    from kiln.operators.bivariate import sample_rows
    vec = standardised_vectors(df, features, id_col)
    m = PCA(k=2, inputCol="features", outputCol="pcs").fit(vec)
    pc = m.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = m.transform(vec).select(id_col, vector_to_array("pcs").alias("_p"))
    out = out.select(id_col, (F.col("_p")[0] * signs[0]).alias("pc1"), (F.col("_p")[1] * signs[1]).alias("pc2"))
    if labels is not None:
        out = out.join(labels, id_col, "left")
    return out if n is None else sample_rows(out, [id_col], n, seed)


@dataclass
class Components:
    """One fitted projection: the variance report, the chosen number of components, and the rows
    (id, ``features`` = chosen components, ``pc1``, ``pc2``)."""
    report: DataFrame
    chosen: int
    rows: DataFrame


def component_space(df: DataFrame, features: list[str], id_col: str, max_components: int = 10) -> Components:
    """M2 fitted once for everything after it: standardise, at most ``max_components`` components, as many
    chosen as first reach 0.95 of the variance (2 at least). Signs are fixed: largest loading positive."""
    vec = standardised_vectors(df, features, id_col)
    m = min(max_components, len(features), vec.limit(max_components + 1).count() - 1)
    if m < MIN_FEATURES:
        raise ValueError("components need two features and three rows")
    fitted = PCA(k=m, inputCol="features", outputCol="pcs").fit(vec)
    shares = fitted.explainedVariance.toArray()
    total = shares.cumsum()
    chosen = max(MIN_FEATURES, next((i + 1 for i, c in enumerate(total) if c >= PCA_VARIANCE), m))
    report = df.sparkSession.createDataFrame([(i + 1, float(x), float(c)) for i, (x, c) in enumerate(zip(shares, total))],
                                             "component int, explained double, cumulative double")
    pc = fitted.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(m)]
    x = vector_to_array("pcs")
    rows = fitted.transform(vec).select(q(id_col), array_to_vector(F.array(*[x[j] * signs[j] for j in range(chosen)])).alias("features"),
                                        (x[0] * signs[0]).alias("pc1"), (x[1] * signs[1]).alias("pc2"))
    return Components(report, chosen, saved(rows, "components"))


SWEEP_SCHEMA = "Model string, k int, inertia double, silhouette double, n_clusters int"


def _assign(held):
    """Per fit and centre: rows, sum of squared distances (a fit's at one of its centres) and sums of the rows
    nearest to the centre. Fits with as many centres are searched together."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = sorted(held.value, key=lambda f: len(f[1]))
        centres = np.vstack([c for _, c in fits])
        left = np.hstack([-2.0 * centres, (centres * centres).sum(axis=1)[:, None]])
        groups, at = [], 0  # (first centre, fits, centres of each)
        for k, same in groupby(len(c) for _, c in fits):
            many = len(list(same))
            groups.append((at, many, k))
            at += many * k
        found, cost = np.zeros((len(centres), 1 + centres.shape[1])), np.zeros(len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, ASSIGN_ROWS):
                x = vectors(batch.column("_v").slice(at, ASSIGN_ROWS))
                ones = np.ones((len(x), 1))
                own = (x * x).sum(axis=1)
                scores = left @ np.hstack([x, ones]).T
                near = np.empty_like(scores)
                for first, many, k in groups:
                    last = first + many * k
                    score = scores[first:last].reshape(many, k, len(x))
                    least = score.min(axis=1)
                    hit = score == least[:, None, :]
                    if np.count_nonzero(hit) != many * len(x):  # ties: the smallest centre
                        hit = np.arange(k)[None, :, None] == score.argmin(axis=1)[:, None, :]
                    near[first:last] = hit.reshape(many * k, len(x))
                    cost[first:last:k] += np.maximum(own + least, 0.0).sum(axis=1)
                found += near @ np.hstack([ones, x])
        of = [(f, i) for f, c in fits for i in range(len(c))]
        rows = [(*of[i], found[i, 0], cost[i], found[i, 1:].tolist()) for i in np.flatnonzero((found[:, 0] > 0) | (cost > 0))]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))],
                                         names=["fit", "centre", "n", "cost", "total"])
    return work


def lloyd(points: DataFrame, starts: list[np.ndarray], max_iter: int = KMEANS_ITERATIONS, tol: float = KMEANS_TOL) -> list[tuple[np.ndarray, float]]:
    """``[(centres, cost)]`` of k-means from each start over the vectors ``_v``, as Spark's estimator refines them:
    a fit ends when none of its centres moved by more than ``tol``, an empty centre stays, and the cost is that
    of the last assignment. All fits share one pass a step; a pass gives out a row per fit, centre and task."""
    spark = points.sparkSession
    ship_package(spark)
    done: list = [(np.array(c, dtype=np.float64), 0.0) for c in starts]
    active = list(range(len(starts)))
    dim = len(starts[0][0])
    for _ in range(max_iter):
        if not active:
            break
        held = spark.sparkContext.broadcast([(f, done[f][0]) for f in active])
        met = points.select("_v").mapInArrow(_assign(held), "fit int, centre int, n double, cost double, total array<double>")
        rows = met.groupBy("fit", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                                F.array(*[F.sum(F.col("total")[j]) for j in range(dim)]).alias("total")).collect()
        held.destroy()
        moved = {f: done[f][0].copy() for f in active}
        cost = dict.fromkeys(active, 0.0)
        for r in rows:
            if r["n"]:
                moved[r["fit"]][r["centre"]] = np.array(r["total"]) / r["n"]
            cost[r["fit"]] += r["cost"]
        still = [f for f in active if (((moved[f] - done[f][0]) ** 2).sum(axis=1) > tol * tol).any()]
        for f in active:
            done[f] = (moved[f], cost[f])
        active = still
    return done


def nearest_centre(vec: Column, centres: np.ndarray) -> Column:
    """The number of the nearest centre, the smallest among ties."""
    away = lambda c: sum(((vec[j] - F.lit(float(x))) * (vec[j] - F.lit(float(x))) for j, x in enumerate(c)), F.lit(0.0))
    all_of = F.array(*[away(c) for c in centres])
    return (F.array_position(all_of, F.array_min(all_of)) - 1).cast("int")


def kmeans_models(vec: DataFrame, id_col: str, k_min: int = 2, k_max: int = 8, n_init: int = 10, seed: int = 42):
    """For each k, the best of ``n_init`` seeded runs (least cost) on the vectors ``features``:
    ``[(k, centres, cost, exact silhouette)]``. Spark's estimator finds the starts (k-means||); the runs of all k
    are then refined together, so that the number of passes is that of the longest run, and the best ones of all k
    share the distances of their silhouettes."""
    vec = vec.select(id_col, "features", vector_to_array("features").alias("_v")).cache()
    k_max = min(k_max, max(2, vec.count() - 1))

    def start(fit: tuple[int, int]) -> np.ndarray:
        k, s = fit
        # a frame that is not cached itself: the estimator holds its vectors unpacked through its passes
        return np.array(KMeans(k=k, seed=seed + s, featuresCol="features", maxIter=0).fit(vec.select("features")).clusterCenters())

    runs = [(k, s) for k in range(k_min, k_max + 1) for s in range(n_init)]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        starts = list(pool.map(start, runs))
    # small tables arrive in one partition; their passes are work for all cores
    spread = vec.select("_v").repartition(max(vec.sparkSession.sparkContext.defaultParallelism, vec.rdd.getNumPartitions())).cache()
    fits = list(zip(runs, lloyd(spread, starts), strict=True))
    spread.unpersist()

    best = {}
    for k in range(k_min, k_max + 1):
        cost, _, centres = min(((cost, s, c) for (of, s), (c, cost) in fits if of == k), key=lambda r: r[:2])
        best[k] = centres, float(cost)
    lab = vec.select(id_col, "_v", *[nearest_centre(F.col("_v"), c).alias(f"_k{k}") for k, (c, _) in best.items()])
    scores = silhouettes(lab, id_col, "_v", [f"_k{k}" for k in best])
    vec.unpersist()
    return [(k, centres, cost, score if n_clusters > 1 else None) for (k, (centres, cost)), (score, n_clusters) in zip(best.items(), scores, strict=True)]


def kmeans_sweep(df: DataFrame, features: list[str], id_col: str, k_min: int = 2, k_max: int = 8,
                 n_init: int = 10, seed: int = 42) -> DataFrame:
    """For each k, the best of ``n_init`` seeded runs (least cost), its exact silhouette
    and inertia (elbow), on the standardised features."""
    found = kmeans_models(standardised_vectors(df, features, id_col), id_col, k_min, k_max, n_init, seed)
    return df.sparkSession.createDataFrame([("KMeans", k, cost, sil, k) for k, _, cost, sil in found], SWEEP_SCHEMA)


@dataclass
class Clustering:
    components: Components
    leaderboard: DataFrame
    best: str | None       # "KMeans (k=3)" or "DBSCAN"; None when nothing has two clusters
    silhouette: float | None
    view: DataFrame        # (id, pc1, pc2, cluster): cluster missing without a best model


def cluster_components(df: DataFrame, features: list[str], id_col: str, k_max: int = 8, eps: float = 0.8,
                       min_samples: int = 5, n_init: int = 10) -> Clustering:
    """M2 -> M3, M4, M5, M6, M7: the k-means sweep, the density clusters and their silhouettes all lie in
    the chosen components of one projection; the best model's clusters go to the two-component view."""
    spark = df.sparkSession
    space = component_space(df, features, id_col)
    found = kmeans_models(space.rows, id_col, 2, k_max, n_init)
    points = space.rows.select(id_col, vector_to_array("features").alias("_v"))
    density = saved(dbscan(points, id_col, "_v", eps, min_samples), "density")
    n_clusters, sil = _density_score(points, density, id_col)
    board = [("KMeans", k, cost, s, k) for k, _, cost, s in found] + [("DBSCAN", None, None, sil, n_clusters)]
    best, score, labels = None, None, None
    for k, centres, _, s in found:
        if s is not None and (score is None or s > score):
            best, score = f"KMeans (k={k})", s
            labels = space.rows.select(id_col, nearest_centre(vector_to_array("features"), centres).alias("cluster"))
    if sil is not None and (score is None or sil > score):
        best, score, labels = "DBSCAN", sil, density
    view = space.rows.select(id_col, "pc1", "pc2")
    view = view.withColumn("cluster", F.lit(None).cast("int")) if labels is None else view.join(labels, id_col, "left")
    return Clustering(space, cluster_leaderboard(spark.createDataFrame(board, SWEEP_SCHEMA)), best, score, view)


def bisecting_kmeans(df: DataFrame, features: list[str], id_col: str, k: int = 4, seed: int = 42) -> DataFrame:
    """Divisive hierarchical clustering (``BisectingKMeans``): cluster per row."""
    vec = standardised_vectors(df, features, id_col)
    m = BisectingKMeans(k=k, seed=seed, featuresCol="features").fit(vec)
    return m.transform(vec).select(id_col, F.col("prediction").alias("cluster"))


def dbscan_run(df: DataFrame, features: list[str], id_col: str, eps: float = 0.8, min_samples: int = 5) -> DataFrame:
    """M4 on the standardised matrix: (id, cluster), noise -1."""
    vec = standardised_vectors(df, features, id_col).select(id_col, vector_to_array("features").alias("_v"))
    return dbscan(vec, id_col, "_v", eps, min_samples)


def dbscan_summary(labels: DataFrame, df: DataFrame, features: list[str], id_col: str) -> tuple[int, float | None]:
    vec = standardised_vectors(df, features, id_col).select(id_col, vector_to_array("features").alias("_v"))
    return _density_score(vec, labels, id_col)


def _density_score(points: DataFrame, labels: DataFrame, id_col: str) -> tuple[int, float | None]:
    n_clusters = labels.where(F.col("cluster") >= 0).select("cluster").distinct().count()
    if n_clusters < 2:  # one cluster beside noise is no separation to score
        return n_clusters, None
    return n_clusters, float(silhouette_exact(points.join(labels, id_col), id_col, "_v", "cluster").first()["silhouette"])


def cluster_leaderboard(rows: DataFrame) -> DataFrame:
    """M6: silhouette descending, missing last."""
    return rows.orderBy(F.desc_nulls_last("silhouette"), "Model", "k")


def cluster_profiles(df: DataFrame, cluster_col: str, features: list[str]) -> DataFrame:
    """Per-cluster size, mean and std of every feature."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in features:
        aggs += [F.avg(F.col(q(c))).alias(f"{c}_mean"), F.stddev_samp(F.col(q(c))).alias(f"{c}_std")]
    return df.groupBy(cluster_col).agg(*aggs)


def enough_for_clustering(df: DataFrame, features: list[str]) -> bool:
    """Size guard: at least 10 rows and 2 features."""
    return len(features) >= MIN_FEATURES and df.limit(MIN_ROWS).count() >= MIN_ROWS
