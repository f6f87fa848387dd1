"""Resampling inside folds, model selection as one run, and saved stages."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kiln.operators import encode, models, selection_run, split, stages
from kiln.sources import io


def table(spark, n=240):
    """Imbalanced: one row in six is of class 1."""
    df = spark.range(n).withColumnRenamed("id", "key")
    u = lambda k: F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1000)) / 1000.0
    label = (F.col("key") % 6 == 0).cast("double")
    return df.select("key", (u(1) + label).alias("x"), (u(2) * 50 - label * 10).alias("y"), label.alias("label")).cache()


def test_no_synthetic_row_comes_from_a_validation_row(spark):
    df = split.assign_folds(table(spark), 3, ["key"], stratify="label")
    # a mark that only validation rows of fold 0 have: far outside, so that it would move what is made of it
    marked = df.withColumn("x", F.when(F.col("fold") == 0, F.col("x") + 1e6).otherwise(F.col("x")))
    parts = selection_run.fold_parts(marked, ["x", "y"], "StandardScaler", "label", True)
    stage, rows = parts[0].prepared(False)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    train = {r["label"]: r["count"] for r in df.where("fold <> 0").groupBy("label").count().collect()}
    assert counts == {0.0: train[0.0], 1.0: train[0.0]}
    assert rows.where(vector_to_array("features")[0] > 1e5).count() == 0
    assert parts[0].valid.where("x > 1e5").count() == parts[0].valid.count() == df.where("fold = 0").count()
    # the part's own training rows are all there, once
    plain = {tuple(r) for r in df.where("fold <> 0").select("x", "y", "label").collect()}
    assert plain <= {(*r[0], r[1]) for r in rows.select(vector_to_array("features"), "label").collect()}


def test_resampled_estimator_predicts_each_row_once(spark):
    df = table(spark)
    model = stages.ResampledEstimator(LogisticRegression(), ["x", "y"]).fit(df)
    assert model.transform(df).count() == df.count()
    plain = stages.ResampledEstimator(LogisticRegression(), ["x", "y"], resample=False).fit(df)
    recall = lambda m: m.transform(df).where("label = 1 and prediction = 1").count()
    assert recall(model) >= recall(plain)


def _specs(*names):
    return [s for s in models.model_registry("classification", 200, 2) if s.name in names]


def test_selection_run_resumes_and_reports(spark, tmp_path):
    tr, te = split.split_stratified(table(spark), "label", ["key"], 0.25, 7)
    args = dict(features=["x", "y"], problem_type="classification", scaler="StandardScaler", key_cols=["key"], specs=_specs("Logistic Regression", "Naive Bayes"),
                top=2, k=2, n_iter=2, state=str(tmp_path / "scores"))
    first = selection_run.select_model(tr, te, **args)
    assert first.resampled and first.folds == 2
    tuning = {r["Model"]: r for r in first.tuning.collect()}
    assert tuning["Naive Bayes"]["method"] == "Direct fit" and tuning["Naive Bayes"]["cv_score"] is None
    assert tuning["Logistic Regression"]["iterations"] == 2 and 0 < tuning["Logistic Regression"]["cv_score"] <= 1
    final = first.final.orderBy("rank").collect()
    assert final[0]["Model"] == first.best_name and all(0 <= r["ROC_AUC"] <= 1 for r in final)
    assert first.curve.count() == 5 and first.before_after.count() == 2
    assert first.best_model.transform(te).count() == te.count()
    fits = []
    again = {**args, "specs": [models.ModelSpec(s.name, lambda s=s, **p: fits.append(s.name) or s.make(**p), s.use_scaler, s.grid) for s in args["specs"]]}
    second = selection_run.select_model(tr, te, **again)
    assert sorted(fits) == ["Logistic Regression", "Naive Bayes"]  # the two refits alone
    assert second.leaderboard.collect() == first.leaderboard.collect() and second.tuning.collect() == first.tuning.collect()


def test_regression_selection(spark):
    df = spark.range(120).select(F.col("id").alias("key"), (F.col("id") % 17).cast("double").alias("x"), ((F.col("id") % 17) * 3.0 + F.col("id") % 2).alias("label"))
    tr, te = split.split_random(df, ["key"], 0.25, 3)
    specs = [s for s in models.model_registry("regression", 90) if s.name in ("Linear Regression", "Ridge")]
    got = selection_run.select_model(tr, te, ["x"], "regression", "StandardScaler", ["key"], specs=specs, k=2, n_iter=2)
    assert not got.resampled and got.final.orderBy("rank").first()["R2"] > 0.95 and got.summary().first()["train_score"] > 0.95


def test_own_stages_save_and_predict_alike(spark, tmp_path):
    df = table(spark, 120)
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features")
    for name, est in (("knn", stages.KNNEstimator(3, "distance", metric="manhattan")), ("knnreg", stages.KNNEstimator(3, task="regression")),
                      ("boost", stages.AdaBoostEstimator(6))):
        model = PipelineModel([vec, est.fit(vec.transform(df))])
        io.save_model(model, str(tmp_path / name))
        back = io.load_model(str(tmp_path / name))
        rows = lambda m: sorted(map(tuple, m.transform(df).select("key", "prediction").collect()))
        assert rows(back) == rows(model) and [type(s) for s in back.stages] == [type(s) for s in model.stages]
    one = stages.AdaBoostEstimator(2).fit(vec.transform(df))
    io.save_model(one, str(tmp_path / "one"))
    assert io.load_model(str(tmp_path / "one")).stumps == one.stumps
    with pytest.raises(Exception, match="(?i)not exist|no such|cannot"):
        io.load_model(str(tmp_path / "nothing"))


def test_yeo_johnson_saves_as_a_stage(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float((i - 30) ** 3)) for i in range(60)], "x double, z double")
    fitted = encode.fit_yeo_johnson(df, ["x", "z"])
    io.save_model(PipelineModel([fitted.stage()]), str(tmp_path / "yj"))
    got = io.load_model(str(tmp_path / "yj")).transform(df).collect()
    want = fitted.transform(df).collect()
    assert all(math.isclose(a["x_yj"], b["x"], abs_tol=1e-9) and math.isclose(a["z_yj"], b["z"], abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_boosting_is_one_stage_without_join(spark):
    df = table(spark)
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    model = stages.AdaBoostEstimator(10).fit(vec)
    out = model.transform(vec)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.select("x", "y", "prediction").collect()
    for r in rows[:50]:
        votes = {}
        for f, t, a, b, w in model.stumps:
            c = a if (r["x"], r["y"])[f] <= t else b
            votes[c] = votes.get(c, 0.0) + w
        assert r["prediction"] == max(sorted(votes), key=lambda c: votes[c])
    assert out.where("prediction = label").count() > 0.9 * df.count()


def test_prepared_rows_are_spread_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(selection_run, "FIT_ROWS", 50)
    df = table(spark).coalesce(1)
    part = selection_run.Part(df, df, ["x", "y"], "StandardScaler", "label", False, 42)
    rows = part.prepared(True)[1]
    assert rows.rdd.getNumPartitions() >= min(4, spark.sparkContext.defaultParallelism) and rows.count() == 240
    monkeypatch.setattr(selection_run, "FIT_ROWS", 1000)
    small = selection_run.Part(df, df, ["x", "y"], "StandardScaler", "label", False, 42).prepared(False)[1]
    assert small.rdd.getNumPartitions() == 1  # too few rows


def test_select_model_runs_all_models_and_the_curve(monkeypatch):
    import inspect

    from kiln.plans import catalog_learn as L
    seen = {}
    signature = inspect.signature(selection_run.select_model)

    def select(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise StopIteration

    monkeypatch.setattr(selection_run, "select_model", select)
    monkeypatch.setattr(L, "_cls_split", lambda *a: (None, None))
    monkeypatch.setattr(L, "_scratch", lambda *a: None)
    with pytest.raises(StopIteration):
        L.q_select_model(None, None)
    assert seen["specs"] is None and seen["curve"] and (seen["top"], seen["k"], seen["n_iter"]) == (3, 5, 12)
