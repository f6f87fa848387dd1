"""Model stages of our own: resampled fits (J4), k-nearest neighbours (K4 / O12) and AdaBoost (K7).

Fitted stages save and load like Spark's: plain values in the metadata, tables as Parquet beside it.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.nearest import nearest_rows
from kiln.operators.scale import STANDARD, fit_scaler
from kiln.session import saved

# ---- saving -----------------------------------------------------------------------------


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"values": self.stage._values()})
        for name, table in self.stage._tables().items():
            table.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in self.cls.TABLES}
        stage = self.cls(**meta["values"], **tables)
        stage._resetUid(meta["uid"])
        return stage


class _Saved(MLWritable, MLReadable):
    """A stage made of plain ``_values`` and of the tables that ``TABLES`` names."""

    TABLES: tuple = ()

    def _values(self) -> dict:
        raise NotImplementedError

    def _tables(self) -> dict:
        return {name: getattr(self, name) for name in self.TABLES}

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


# ---- scale, resample, fit -----------------------------------------------------------------

def prepare_training(train: DataFrame, features: list[str], scaler: str = STANDARD, use_scaler: bool = True, label: str = "label",
                     resample: bool = False, k: int = 5, seed: int = 42) -> tuple[list, DataFrame]:
    """What comes before the estimator's fit: the fitted stages (scaler, assembler), and the training
    rows (features vector, label), oversampled (I5, after scaling) if ``resample``.

    Only ``train`` is read, so nothing of a validation fold gets into the scaler or the synthetic
    rows; the stages themselves never change the rows of what they transform.
    """
    stages, cols = [], features
    if use_scaler:
        fitted = fit_scaler(train, features, scaler)
        cols = [f"_scaled_{i}" for i in range(len(features))]
        items = ", ".join(f"{fitted.sql(c)} AS {s}" for c, s in zip(features, cols, strict=True))
        stages.append(SQLTransformer(statement=f"SELECT *, {items} FROM __THIS__"))
    assemble = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    rows = stages[0].transform(train) if stages else train
    if resample:
        from kiln.operators.neighbours import smote
        # a row number of our own, fixed by the saved table: keys of any kind and number will do
        numbered = saved(rows.select(*cols, label, F.monotonically_increasing_id().alias("_row")), "training")
        rows = smote(numbered, label, cols, "_row", k, seed)
    return [*stages, assemble], assemble.transform(rows).select("features", label)


class ResampledEstimator(Estimator):
    """J4 + I5: scaler, oversampling and estimator as one estimator. ``fit`` scales, oversamples the
    training rows and fits; the model it returns scales and predicts every row it is given, once."""

    def __init__(self, estimator, features: list[str], scaler: str = STANDARD, use_scaler: bool = True, label: str = "label",
                 resample: bool = True, seed: int = 42):
        super().__init__()
        self.estimator, self.features, self.scaler, self.use_scaler = estimator, features, scaler, use_scaler
        self.label, self.resample, self.seed = label, resample, seed

    def copy(self, extra=None):
        return ResampledEstimator(self.estimator.copy(extra), self.features, self.scaler, self.use_scaler, self.label, self.resample, self.seed)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        stages, rows = prepare_training(dataset, self.features, self.scaler, self.use_scaler, self.label, self.resample, seed=self.seed)
        return PipelineModel([*stages, self.estimator.fit(rows)])


# ---- k-nearest neighbours -------------------------------------------------------------------

class KNNModel(Model, _Saved):
    """Predicts from the k nearest training rows; classification adds the ``probability`` of each class
    (share of the neighbours' weights) and takes the likeliest, ties by smaller class."""

    TABLES = ("train",)

    def __init__(self, train: DataFrame, k: int, weights: str, task: str, features_col: str, label_col: str, metric: str = "euclidean",
                 classes: list | None = None):
        super().__init__()
        self.train, self.k, self.weights, self.task, self.metric = train, k, weights, task, metric
        self.features_col, self.label_col, self.classes = features_col, label_col, classes or []

    def _values(self) -> dict:
        return {"k": self.k, "weights": self.weights, "task": self.task, "features_col": self.features_col, "label_col": self.label_col,
                "metric": self.metric, "classes": self.classes}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # saved, so that both readers of the row numbers see the same ones
        rows = saved(dataset.withColumn("_kid", F.monotonically_increasing_id()), "queries")
        found = nearest_rows(rows.select(F.col("_kid").alias("_qid"), vector_to_array(self.features_col).alias("_qv")), self.train, self.k, metric=self.metric)
        w = F.lit(1.0) if self.weights == "uniform" else F.when(F.col("_dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("_dist"))
        found = found.withColumn("_w", w)
        if self.task != "classification":
            found = found.groupBy(F.col("_qid").alias("_kid")).agg((F.sum(F.col("_w") * F.col("_tlabel")) / F.sum("_w")).alias("prediction"))
        else:
            votes = [F.sum(F.when(F.col("_tlabel") == F.lit(float(c)), F.col("_w")).otherwise(0.0)) for c in self.classes]
            found = found.groupBy(F.col("_qid").alias("_kid")).agg(F.array(*votes).alias("_v"))
            total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
            best = F.array_position(F.col("_v"), F.array_max("_v")).cast("int")
            found = found.select("_kid", array_to_vector(F.transform("_v", lambda x: x / total)).alias("probability"),
                                 F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), best).alias("prediction"))
        return rows.join(found, "_kid", "left").drop("_kid")


class KNNEstimator(Estimator):
    """K4 / O12 as an estimator: the fit keeps the training vectors in a saved table."""

    def __init__(self, k: int = 5, weights: str = "uniform", task: str = "classification", featuresCol: str = "features",
                 labelCol: str = "label", metric: str = "euclidean"):
        super().__init__()
        self.k, self.weights, self.task, self.featuresCol, self.labelCol, self.metric = k, weights, task, featuresCol, labelCol, metric

    def copy(self, extra=None):
        e = KNNEstimator(self.k, self.weights, self.task, self.featuresCol, self.labelCol, self.metric)
        for p, v in (extra or {}).items():
            setattr(e, p if isinstance(p, str) else p.name, v)
        return e

    def _fit(self, dataset: DataFrame) -> KNNModel:
        train = saved(dataset.select(F.monotonically_increasing_id().alias("_tid"), vector_to_array(self.featuresCol).alias("_tv"),
                                     F.col(self.labelCol).cast("double").alias("_tlabel")), "knn")
        classes = sorted(r[0] for r in train.select("_tlabel").where("_tlabel is not null").distinct().collect()) if self.task == "classification" else []
        return KNNModel(train, self.k, self.weights, self.task, self.featuresCol, self.labelCol, self.metric, classes)


# ---- AdaBoost ---------------------------------------------------------------------------------

class AdaBoostModel(Model, _Saved):
    """All stumps as one score expression: (feature, threshold, class at most, class above, weight). No
    join and no generated id; ``probability`` holds each class's share of the weights."""

    def __init__(self, stumps: list, classes: list, featuresCol: str = "features"):
        super().__init__()
        self.stumps, self.classes, self.featuresCol = [tuple(s) for s in stumps], classes, featuresCol

    def _values(self) -> dict:
        return {"stumps": [list(s) for s in self.stumps], "classes": self.classes, "featuresCol": self.featuresCol}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(F.col(self.featuresCol))
        terms = F.array(*[F.struct(F.when(F.get(x, F.lit(int(f))) <= F.lit(float(t)), F.lit(float(a))).otherwise(F.lit(float(b))).alias("c"),
                                   F.lit(float(w)).alias("w")) for f, t, a, b, w in self.stumps])
        score = lambda c: F.aggregate("_votes", F.lit(0.0), lambda s, v: s + F.when(v["c"] == F.lit(float(c)), v["w"]).otherwise(0.0))
        scores = F.array(*[score(c) for c in self.classes])
        out = dataset.withColumn("_votes", terms).withColumn("_scores", scores)
        total = sum(s[4] for s in self.stumps) or 1.0
        best = F.array_position(F.col("_scores"), F.array_max("_scores")).cast("int")
        return out.withColumn("probability", array_to_vector(F.transform("_scores", lambda s: s / F.lit(float(total))))).withColumn(
            "prediction", F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), best)).drop("_votes", "_scores")


def _stump(model) -> tuple:
    """(feature, threshold, class at most, class above) of a fitted tree of depth 1; of a tree that does
    not split, its one class on both sides."""
    root = model._java_obj.rootNode()
    if model.depth == 0:
        return 0, math.inf, root.prediction(), root.prediction()
    return root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction()


class AdaBoostEstimator(Estimator):
    """K7: SAMME boosting of depth-1 trees; the weights of the rows are a column, saved every round."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.n, self.lr, self.featuresCol, self.labelCol = n_estimators, learning_rate, featuresCol, labelCol

    def copy(self, extra=None):
        return AdaBoostEstimator(self.n, self.lr, self.featuresCol, self.labelCol)

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        counts = dataset.groupBy(self.labelCol).count().collect()
        classes, n, k = sorted(float(r[0]) for r in counts), sum(r["count"] for r in counts), len(counts)
        cur = saved(dataset.select(self.featuresCol, F.col(self.labelCol).cast("double").alias(self.labelCol), F.lit(1.0 / n).alias("_w")), "boost")
        stumps: list = []
        for _ in range(self.n):
            m = DecisionTreeClassifier(maxDepth=1, featuresCol=self.featuresCol, labelCol=self.labelCol, weightCol="_w").fit(cur)
            f, t, a, b = _stump(m)
            guess = F.when(F.get(vector_to_array(self.featuresCol), F.lit(int(f))) <= F.lit(float(t)), F.lit(float(a))).otherwise(F.lit(float(b)))
            wrong = (guess != F.col(self.labelCol)).cast("double")
            err, total = cur.agg(F.sum(F.col("_w") * wrong), F.sum("_w")).first()
            err = err / total
            if err >= 1 - 1.0 / k:
                break
            alpha = self.lr * (math.log((1 - err) / max(err, 1e-12)) + math.log(max(k - 1, 1)))
            stumps.append((f, t, a, b, alpha))
            if err <= 0:
                break
            scale = total * (1 - err + err * math.exp(alpha))
            cur = saved(cur.withColumn("_w", F.col("_w") * F.exp(F.lit(alpha) * wrong) / F.lit(scale)), "boost")
        if not stumps:  # no stump beats a guess: the commonest class
            top = float(max(counts, key=lambda r: (r["count"], -float(r[0])))[0])
            stumps = [(0, math.inf, top, top, 1.0)]
        return AdaBoostModel(stumps, classes, self.featuresCol)
