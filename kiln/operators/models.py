"""K: estimators, model registry, leaderboards, cross-validation and random search.

Every fit is a distributed ``pyspark.ml`` fit on a cached training
DataFrame; the driver only loops over candidate models and parameter
combinations (a handful) and collects one metric row per fit.
"""

from __future__ import annotations

import itertools
import random
from dataclasses import dataclass, field

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.evaluate import classification_metrics, regression_metrics, roc_auc_binary, roc_auc_ovr_long
from kiln.operators.scale import build_pipeline
from kiln.operators.stages import AdaBoostEstimator, KNNEstimator  # noqa: F401 - AdaBoost is no default model

MAX_DEPTH_NONE = 30  # Spark trees allow depth <= 30; "no limit" maps here
PARALLELISM = 4      # concurrent fits (like CrossValidator's parallelism); each fit is distributed


def _parallel(fn, items, parallelism: int = PARALLELISM):
    """Run independent fits concurrently from driver threads (Spark schedules their jobs together)."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as ex:
        return list(ex.map(fn, items))


# ---- registry (K8) ---------------------------------------------------------------------

@dataclass
class ModelSpec:
    name: str
    make: object                      # callable(params) -> Estimator
    use_scaler: bool
    grid: dict = field(default_factory=dict)


#: The search lists, under Spark's parameter names (no depth limit: Spark's largest depth).
#: Solvers, minimum split sizes and distance exponents have no counterpart in Spark's estimators.
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
    "tree": {"maxDepth": [MAX_DEPTH_NONE, 5, 10, 20], "minInstancesPerNode": [1, 2, 4]},
    "forest": {"numTrees": [100, 200, 300], "maxDepth": [MAX_DEPTH_NONE, 8, 16, 24], "minInstancesPerNode": [1, 2, 4]},
    "boosting": {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1, 0.2], "maxDepth": [2, 3, 4]},
    "neighbours": {"k": [3, 5, 7, 9, 11, 15, 21], "weights": ["uniform", "distance"]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0]},
}


def model_registry(problem_type: str, n_train: int, n_classes: int = 2) -> list[ModelSpec]:
    """K8: name -> estimator factory, whether to scale, parameter lists."""
    if problem_type == "classification":
        def logreg(C=1.0, maxIter=2000):
            return LogisticRegression(maxIter=maxIter, regParam=1.0 / (C * max(n_train, 1)),
                                      elasticNetParam=0.0, standardization=False)

        def gbt(maxIter=100, stepSize=0.1, maxDepth=3):
            est = GBTClassifier(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=42)
            return est if n_classes <= 2 else OneVsRest(classifier=est)
        return [
            ModelSpec("Logistic Regression", logreg, True, GRIDS["logistic"]),
            ModelSpec("Decision Tree", lambda maxDepth=MAX_DEPTH_NONE, minInstancesPerNode=1:
                      DecisionTreeClassifier(maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=42),
                      False, GRIDS["tree"]),
            ModelSpec("Random Forest", lambda numTrees=100, maxDepth=MAX_DEPTH_NONE, minInstancesPerNode=1:
                      RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth,
                                             minInstancesPerNode=minInstancesPerNode, seed=42),
                      False, GRIDS["forest"]),
            ModelSpec("Gradient Boosting", gbt, False,
                      GRIDS["boosting"]),
            ModelSpec("KNN", lambda k=5, weights="uniform": KNNEstimator(k, weights, "classification"), True,
                      GRIDS["neighbours"]),
            ModelSpec("Naive Bayes", lambda: NaiveBayes(modelType="gaussian"), False, {}),
        ]
    return [
        ModelSpec("Linear Regression", lambda: LinearRegression(regParam=0.0, standardization=False), True, {}),
        ModelSpec("Ridge", lambda alpha=1.0: LinearRegression(regParam=alpha / max(n_train, 1), elasticNetParam=0.0,
                                                              standardization=False),
                  True, GRIDS["ridge"]),
        ModelSpec("Lasso", lambda alpha=1.0: LinearRegression(regParam=alpha, elasticNetParam=1.0,
                                                              standardization=False, maxIter=5000),
                  True, GRIDS["lasso"]),
        ModelSpec("Elastic Net", lambda alpha=1.0, l1_ratio=0.5: LinearRegression(
            regParam=alpha, elasticNetParam=l1_ratio, standardization=False, maxIter=1000),
                  True, {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]}),
        ModelSpec("Random Forest", lambda numTrees=100, maxDepth=MAX_DEPTH_NONE, minInstancesPerNode=1:
                  RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth,
                                        minInstancesPerNode=minInstancesPerNode, seed=42),
                  False, GRIDS["forest"]),
        ModelSpec("Gradient Boosting", lambda maxIter=100, stepSize=0.1, maxDepth=3:
                  GBTRegressor(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=42),
                  False, GRIDS["boosting"]),
        ModelSpec("KNN", lambda k=5: KNNEstimator(k, "uniform", "regression"), True, {"k": [3, 5, 7, 11]}),
    ]


#: Scores that a board shows, by problem type.
METRICS = {"classification": ["Accuracy", "Precision", "Recall", "F1"], "regression": ["R2", "RMSE", "MAE"]}


def roc_auc(pred: DataFrame, label: str = "label") -> float | None:
    """ROC-AUC of a model's class probabilities (class c at place c): binary, or one-vs-rest weighted by
    support; None for models without probabilities or rows of one class."""
    if "probability" not in pred.columns:
        return None
    arr = pred.where(F.col(label).isNotNull() & F.col("probability").isNotNull()).select(F.col(label).cast("int").alias("y"), vector_to_array("probability").alias("p"))
    width, classes, largest = arr.agg(F.max(F.size("p")), F.count_distinct("y"), F.max("y")).first()
    if not width or classes < 2 or largest >= width:
        return None
    if width == 2:
        auc = roc_auc_binary(arr.select("y", F.col("p")[1].alias("s")), "y", "s", positive=1)
    else:
        auc = roc_auc_ovr_long(arr.select("y", F.posexplode("p").alias("class", "score")).withColumn("is_pos", F.col("y") == F.col("class")))
    return auc.first()["auc"]


def _score(pred: DataFrame, problem_type: str, label: str = "label") -> dict:
    if problem_type == "classification":
        r = classification_metrics(pred, label, "prediction").first()
        return {"Accuracy": r["accuracy"], "Precision": r["precision"], "Recall": r["recall"], "F1": r["f1"], "ROC_AUC": roc_auc(pred, label)}
    r = regression_metrics(pred, label, "prediction").first()
    return {"R2": r["r2"], "RMSE": r["rmse"], "MAE": r["mae"]}


def fit_predict(spec: ModelSpec, params: dict, train: DataFrame, test: DataFrame, features: list[str],
                scaler: str, label: str = "label", resample: bool = False):
    """Fit on ``train`` (scaled and, if asked, oversampled inside the fit) and predict ``test``."""
    est = spec.make(**params)
    if hasattr(est, "setLabelCol"):
        est = est.setLabelCol(label)
    model = build_pipeline(est, features, scaler, spec.use_scaler, label, resample).fit(train)
    return model, model.transform(test)


def baseline_leaderboard(train: DataFrame, test: DataFrame, features: list[str], problem_type: str,
                         scaler: str, label: str = "label", specs: list[ModelSpec] | None = None,
                         top: int = 3, resample: bool = False) -> DataFrame:
    """K9: fit every registered model with defaults, score on test, rank, keep all rows (rank column)."""
    spark = train.sparkSession
    n = train.count()
    ncls = train.select(label).distinct().count() if problem_type == "classification" else 0
    specs = specs or model_registry(problem_type, n, ncls)
    from kiln.operators.selection_run import Part
    part = Part(train, test, features, scaler, label, resample, 42)
    prepare_all([part], specs)

    def one(s):
        return {"Model": s.name, **_score(part.fit(s, {}).transform(test), problem_type, label)}

    rows = _parallel(one, specs)
    return leaderboard_frame(spark, rows, problem_type)


def leaderboard_frame(spark, rows: list[dict], problem_type: str) -> DataFrame:
    if problem_type == "classification":
        cols = [*METRICS[problem_type], "ROC_AUC"]
        order = [F.desc_nulls_last("F1"), F.desc_nulls_last("Recall"), F.desc_nulls_last("Accuracy")]
    else:
        cols = METRICS[problem_type]
        order = [F.desc_nulls_last("R2"), F.asc_nulls_last("RMSE"), F.asc_nulls_last("MAE")]
    data = [(r["Model"], *[None if r.get(c) is None else float(r[c]) for c in cols]) for r in rows]
    df = spark.createDataFrame(data, "Model string, " + ", ".join(f"{c} double" for c in cols))
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.asc("Model"))))


def prepare_all(parts: list, specs: list[ModelSpec]) -> None:
    """Prepare each training part once for every scaler choice, before fits share it from several threads."""
    _parallel(lambda t: t[0].prepared(t[1]), [(p, u) for p in parts for u in sorted({s.use_scaler for s in specs})])


def cross_validate(df: DataFrame, features: list[str], problem_type: str, scaler: str, specs: list[ModelSpec],
                   fold_col: str = "fold", label: str = "label", resample: bool = False) -> DataFrame:
    """Per-fold weighted F1 (or R2) per model; mean and population std. Scaling and oversampling
    happen inside each training part."""
    import statistics

    from kiln.operators.selection_run import fold_parts
    spark = df.sparkSession
    parts = fold_parts(df, features, scaler, label, resample, fold_col=fold_col)
    folds = range(len(parts))
    key = "F1" if problem_type == "classification" else "R2"

    def one(task):
        s, f = task
        return _score(parts[f].fit(s, {}).transform(parts[f].valid), problem_type, label)[key]

    tasks = [(s, f) for s in specs for f in folds]
    prepare_all(parts, specs)
    scores = dict(zip([(s.name, f) for s, f in tasks], _parallel(one, tasks)))
    rows = []
    for s in specs:
        vals = [scores[(s.name, f)] for f in folds if scores[(s.name, f)] is not None]
        rows.append((s.name, float(statistics.fmean(vals)) if vals else None,
                     float(statistics.pstdev(vals)) if vals else None, [float(v) for v in vals]))
    return spark.createDataFrame(rows, "Model string, cv_mean double, cv_std double, fold_scores array<double>")


def sample_params(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """min(n_iter, |space|) combinations sampled without replacement (seeded)."""
    if not grid:
        return [{}]
    keys = sorted(grid)
    space = list(itertools.product(*[grid[k] for k in keys]))
    pick = random.Random(seed).sample(range(len(space)), min(n_iter, len(space)))
    return [dict(zip(keys, space[i])) for i in pick]


def random_search(df: DataFrame, features: list[str], problem_type: str, scaler: str, spec: ModelSpec,
                  n_iter: int = 12, fold_col: str = "fold", label: str = "label", seed: int = 42, resample: bool = False) -> DataFrame:
    """CV score of each sampled combination; best first."""
    from kiln.operators.selection_run import fold_parts
    spark = df.sparkSession
    key = "F1" if problem_type == "classification" else "R2"
    parts = fold_parts(df, features, scaler, label, resample, seed, fold_col)
    folds = range(len(parts))
    combos = sample_params(spec.grid, n_iter, seed)

    def one(task):
        i, f = task
        return _score(parts[f].fit(spec, combos[i]).transform(parts[f].valid), problem_type, label)[key]

    tasks = [(i, f) for i in range(len(combos)) for f in folds]
    prepare_all(parts, [spec])
    scores = dict(zip(tasks, _parallel(one, tasks)))
    rows = []
    for i, params in enumerate(combos):
        vals = [scores[(i, f)] for f in folds if scores[(i, f)] is not None]
        rows.append((spec.name, str(sorted(params.items())), float(sum(vals) / len(vals)) if vals else None))
    out = spark.createDataFrame(rows, "Model string, params string, cv_score double")
    return out.orderBy(F.desc_nulls_last("cv_score"), "params")


def before_after(baseline: DataFrame, tuned: DataFrame, metrics: list[str]) -> DataFrame:
    """Baseline and tuned scores side by side (left join on Model, then inner)."""
    b = baseline.select("Model", *[F.col(m).alias(f"{m}_Before") for m in metrics])
    t = tuned.select("Model", *[F.col(m).alias(f"{m}_After") for m in metrics])
    left = b.join(t, "Model", "left")
    return left.join(t.select("Model"), "Model", "inner")


def feature_importance(model, features: list[str], top: int = 15):
    """Tree importances, else mean |coefficient| per feature; returns (feature, importance) rows."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(stage, "featureImportances"):
        imp = stage.featureImportances.toArray().tolist()
    elif hasattr(stage, "coefficientMatrix"):
        m = stage.coefficientMatrix.toArray()
        imp = abs(m).mean(axis=0).tolist()
    elif hasattr(stage, "coefficients"):
        imp = [abs(v) for v in stage.coefficients.toArray().tolist()]
    else:
        return []
    pairs = sorted(zip(features, imp), key=lambda kv: -kv[1])
    return pairs[:top]
