"""Registered queries for model selection (K, I7, L7), the unsupervised branch (M, O5, O6,
O11, O13), the train-safe imputer (C10) and the sinks (A5-A7)."""

from __future__ import annotations

import ast
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kiln.operators import clean, models, selection_run, sparse, split, unsupervised
from kiln.operators.extras import select_by_importance
from kiln.plans.catalog_model import MD5_ORDER
from kiln.plans.catalog_prep import _round_doubles
from kiln.plans.fixtures import lineitem_nulls, table, with_views
from kiln.session import checkpoint_dir
from kiln.sources import io

Q: dict = {}
O: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


CLS_FEATURES = ["n_chars", "toxic", "is_en"]


def _cls_data(spark, sf):
    """labels + document facts: predict ``quality``."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("lang") == "en").cast("int").alias("is_en"))
    lab = table(spark, sf, "labels").join(d, "doc_id")
    return lab.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                      F.col("toxic").cast("double").alias("toxic"), F.col("is_en").cast("double").alias("is_en"),
                      F.col("quality").cast("double").alias("label"))


REG_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _reg_data(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *REG_FEATURES, F.col("l_extendedprice").alias("label"))


def _cls_split(spark, sf):
    df = _cls_data(spark, sf)
    return split.split_stratified(df, "label", ["doc_id"], 0.2, 42)


def _specs(problem, names, n, ncls=2):
    return [s for s in models.model_registry(problem, n, ncls) if s.name in names]


def q_baseline_leaderboard(spark, sf):
    """K1-K3, K5, K8, K9 + O10 (naive Bayes): every classifier with defaults, ranked F1 > Recall > Accuracy."""
    tr, te = _cls_split(spark, sf)
    scaler = "StandardScaler"
    specs = _specs("classification", ["Logistic Regression", "Decision Tree", "Random Forest",
                                      "Gradient Boosting", "KNN", "Naive Bayes"], tr.count())
    return _round_doubles(models.baseline_leaderboard(tr, te, CLS_FEATURES, "classification", scaler, specs=specs,
                                                      resample=selection_run.needs_resampling(tr, "label")))


Q["baseline_leaderboard"] = q_baseline_leaderboard


def q_regression_leaderboard(spark, sf):
    """K6 (+ ridge / lasso / elastic net, forest, boosting, kNN regression): ranked R2 > RMSE > MAE."""
    df = _reg_data(spark, sf)
    tr, te = split.split_random(df, ["l_orderkey", "l_linenumber"], 0.2, 42)
    specs = _specs("regression", ["Linear Regression", "Ridge", "Lasso", "Elastic Net", "Random Forest",
                                  "Gradient Boosting", "KNN"], tr.count())
    return _round_doubles(models.baseline_leaderboard(tr, te, REG_FEATURES, "regression", "StandardScaler",
                                                      specs=specs))


Q["regression_leaderboard"] = q_regression_leaderboard


def _folded(spark, sf, k=5):
    tr, _ = _cls_split(spark, sf)
    kk = split.fold_count(tr, k, "label")
    return split.assign_folds(tr, kk, ["doc_id"], stratify="label")


def q_cross_validate(spark, sf):
    """Per-fold weighted F1 of three models on stratified folds; mean and population std."""
    df = _folded(spark, sf)
    specs = _specs("classification", ["Logistic Regression", "Decision Tree", "Naive Bayes"], df.count())
    return _round_doubles(models.cross_validate(df, CLS_FEATURES, "classification", "StandardScaler", specs,
                                                resample=selection_run.needs_resampling(df, "label")))


Q["cross_validate"] = q_cross_validate


def q_random_search(spark, sf):
    """12 sampled decision-tree settings scored by 3-fold CV (seeded sample, no replacement)."""
    df = _folded(spark, sf, 3)
    spec = _specs("classification", ["Decision Tree"], df.count())[0]
    return _round_doubles(models.random_search(df, CLS_FEATURES, "classification", "StandardScaler", spec, 12,
                                               resample=selection_run.needs_resampling(df, "label")))


Q["random_search"] = q_random_search


def q_before_after(spark, sf):
    """Baseline vs tuned scores joined on Model (tuned = best of 12 sampled settings by 3-fold CV, refit on train)."""
    tr, te = _cls_split(spark, sf)
    n = tr.count()
    specs = _specs("classification", ["Logistic Regression", "Decision Tree"], n)
    base = models.baseline_leaderboard(tr, te, CLS_FEATURES, "classification", "StandardScaler", specs=specs)
    folded = _folded(spark, sf, 3)
    tuned_rows = []
    for s in specs:
        best = models.random_search(folded, CLS_FEATURES, "classification", "StandardScaler", s, 12).first()
        params = dict(ast.literal_eval(best["params"]))
        _, pred = models.fit_predict(s, params, tr, te, CLS_FEATURES, "StandardScaler")
        tuned_rows.append({"Model": s.name, **models._score(pred, "classification")})
    tuned = models.leaderboard_frame(spark, tuned_rows, "classification")
    return _round_doubles(models.before_after(base, tuned, ["F1", "Accuracy"]))


Q["before_after"] = q_before_after


def q_select_model(spark, sf):
    """K9-K12, I7, L7 in one run over all models (the three best are tuned, the chosen one gets its learning curve):
    the chosen one, its setting and scores."""
    tr, te = _cls_split(spark, sf)
    run = selection_run.select_model(tr, te, CLS_FEATURES, "classification", "StandardScaler", ["doc_id"], state=_scratch(spark, "scores"))
    return _round_doubles(run.summary())


Q["select_model"] = q_select_model


@register("fold_training_classes", f"""WITH d AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id)),
s AS (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM d GROUP BY quality)),
f AS (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY {MD5_ORDER.format(k='doc_id')}) - 1) % least(5, (SELECT lo FROM s)) AS fold FROM d),
c AS (SELECT g.fold, f.quality, count(*) AS n FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY ALL)
SELECT CAST(fold AS INT) AS fold, CAST(quality AS DOUBLE) AS label,
       CASE WHEN lo < 0.6 * hi AND lo >= 2 THEN max(n) OVER (PARTITION BY fold) ELSE n END AS n FROM c, s""")
def q_fold_training_classes(spark, sf):
    """J4 + I5: class counts of every fold's training part, as the models see it (resampled if unbalanced)."""
    df = _cls_data(spark, sf)
    folded = split.assign_folds(df, split.fold_count(df, 5, "label"), ["doc_id"], stratify="label")
    parts = selection_run.fold_parts(folded, CLS_FEATURES, "StandardScaler", "label", selection_run.needs_resampling(df, "label"))
    counts = [p.prepared(True)[1].groupBy("label").agg(F.count("*").alias("n")).select(F.lit(i).alias("fold"), "label", "n") for i, p in enumerate(parts)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def q_feature_importance(spark, sf):
    """K13 + O13: random-forest importances and the features at or above the mean importance."""
    tr, _ = _cls_split(spark, sf)
    spec = _specs("classification", ["Random Forest"], tr.count())[0]
    model, _ = models.fit_predict(spec, {}, tr, tr.limit(1), CLS_FEATURES, "StandardScaler")
    imp = models.feature_importance(model, CLS_FEATURES)
    keep = set(select_by_importance(imp))
    return _round_doubles(spark.createDataFrame([(f, float(v), f in keep) for f, v in imp],
                                                "feature string, importance double, selected boolean"))


Q["feature_importance"] = q_feature_importance


def q_adaboost(spark, sf):
    """K7: SAMME boosting of 50 stumps; test predictions."""
    tr, te = _cls_split(spark, sf)
    spec = models.ModelSpec("AdaBoost", lambda: models.AdaBoostEstimator(), False, {})
    _, pred = models.fit_predict(spec, {}, tr, te, CLS_FEATURES, "StandardScaler")
    return pred.select("doc_id", "label", "prediction")


Q["adaboost"] = q_adaboost


def q_learning_curve(spark, sf):
    """Train / validation F1 for 5 nested training sizes (hash-ordered subsets) x 3 folds."""
    from kiln.functions.exprs import hash_unit
    df = _folded(spark, sf, 3).withColumn("_u", hash_unit(["doc_id"], 7))
    spec = _specs("classification", ["Logistic Regression"], df.count())[0]
    rows = []
    folds = sorted(r[0] for r in df.select("fold").distinct().collect())
    for frac in (0.1, 0.325, 0.55, 0.775, 1.0):
        tr_s, va_s = [], []
        for f in folds:
            tr = df.where((F.col("fold") != f) & (F.col("_u") < frac))
            va = df.where(F.col("fold") == f)
            model, pred = models.fit_predict(spec, {}, tr, va, CLS_FEATURES, "StandardScaler")
            va_s.append(models._score(pred, "classification")["F1"])
            tr_s.append(models._score(model.transform(tr), "classification")["F1"])
        rows.append((frac, float(sum(tr_s) / len(tr_s)), float(sum(va_s) / len(va_s))))
    return _round_doubles(spark.createDataFrame(rows, "train_fraction double, train_f1 double, validation_f1 double"))


Q["learning_curve"] = q_learning_curve


def q_train_vs_validation(spark, sf):
    """Train accuracy next to the CV mean of the same model."""
    df = _folded(spark, sf, 3)
    spec = _specs("classification", ["Decision Tree"], df.count())[0]
    cv = models.cross_validate(df, CLS_FEATURES, "classification", "StandardScaler", [spec]).first()
    model, pred = models.fit_predict(spec, {}, df, df, CLS_FEATURES, "StandardScaler")
    tr = models._score(pred, "classification")
    return _round_doubles(spark.createDataFrame([(spec.name, float(tr["Accuracy"]), float(tr["F1"]),
                                                  float(cv["cv_mean"]))],
                                                "Model string, train_accuracy double, train_f1 double, cv_f1 double"))


Q["train_vs_validation"] = q_train_vs_validation


# ---- C10: train-safe imputer ------------------------------------------------------------------------

@register("fit_train_imputer", with_views("lineitem_nulls") + """,
o AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' ||
        CAST(l_linenumber AS VARCHAR))) AS rn FROM lineitem_nulls),
cut AS (SELECT ceil(count(*) * 0.2::DOUBLE) AS k FROM lineitem_nulls),
train AS (SELECT * FROM o WHERE rn > (SELECT k FROM cut)),
test AS (SELECT * FROM o WHERE rn <= (SELECT k FROM cut)),
m AS (SELECT avg(l_quantity) AS mq FROM train),
md AS (SELECT l_returnflag AS v FROM train WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
       ORDER BY count(*) DESC, l_returnflag LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT mq FROM m)), 6) AS l_quantity,
       coalesce(l_returnflag, (SELECT v FROM md)) AS l_returnflag FROM test""")
def q_fit_train_imputer(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    tr, te = split.split_random(df, ["l_orderkey", "l_linenumber"], 0.2, 42)
    imp = clean.fit_train_imputer(tr, te, ["l_quantity", "l_returnflag"])
    return _round_doubles(imp.transform_test(te))


# ---- M: unsupervised ----------------------------------------------------------------------------------

@register("unsupervised_matrix", """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  round(o_totalprice, 6) AS o_totalprice, round(epoch_us(o_orderdate) / 1e6, 6) AS o_orderdate,
  CAST(o_orderstatus = 'O' AS DOUBLE) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS DOUBLE) AS o_orderstatus_P,
  CAST(o_orderpriority = '2-HIGH' AS DOUBLE) AS "o_orderpriority_2-HIGH",
  CAST(o_orderpriority = '3-MEDIUM' AS DOUBLE) AS "o_orderpriority_3-MEDIUM",
  CAST(o_orderpriority = '4-NOT SPECIFIED' AS DOUBLE) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(o_orderpriority = '5-LOW' AS DOUBLE) AS "o_orderpriority_5-LOW" FROM orders""")
def q_unsupervised_matrix(spark, sf):
    return _round_doubles(unsupervised.unsupervised_matrix(table(spark, sf, "orders"), id_col="o_orderkey"))


@register("one_hot_sparse", """WITH r AS (SELECT l_orderkey, l_linenumber,
  dense_rank() OVER (ORDER BY CAST(l_orderkey AS VARCHAR)) - 1 AS order_slot, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS f FROM lineitem),
n AS (SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_returnflag) AS flags FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(order_slot AS INT) AS order_slot, CAST(orders + f AS INT) AS flag_slot,
  CAST(orders + flags AS INT) AS size, 2 AS n_ones FROM r, n""")
def q_one_hot_sparse(spark, sf):
    """G18 with a level per order (1,500,000 x scale factor): the two slots of every line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("order"), "l_returnflag")
    x = F.col("features")
    return sparse.one_hot_sparse(li, ["order", "l_returnflag"], drop_first=False).select(
        "l_orderkey", "l_linenumber", x["indices"][0].alias("order_slot"), x["indices"][1].alias("flag_slot"), x["size"].alias("size"),
        F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v).cast("int").alias("n_ones"))


@register("sparse_matrix", """WITH r AS (SELECT *, dense_rank() OVER (ORDER BY c_name) - 1 AS a, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS b FROM customer),
n AS (SELECT count(DISTINCT c_name) - 1 AS names, count(DISTINCT c_mktsegment) - 1 AS segments FROM customer)
SELECT c_custkey, CAST(2 + names + segments AS INT) AS size, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
  concat_ws(',', CASE WHEN a > 0 THEN CAST(1 + a AS VARCHAR) END, CASE WHEN b > 0 THEN CAST(1 + names + b AS VARCHAR) END) AS hot FROM r, n""")
def q_sparse_matrix(spark, sf):
    """M1 with a level per customer name: the two numbers and the hot slots of every row."""
    x = F.col("features")
    return sparse.sparse_matrix(table(spark, sf, "customer"), "c_custkey").select(
        "c_custkey", x["size"].alias("size"), x["values"][0].alias("c_nationkey"), x["values"][1].alias("c_acctbal"),
        F.array_join(F.slice(x["indices"], 3, 2).cast("array<string>"), ",").alias("hot"))


def _cluster_input(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"),
                                            F.col("c_nationkey").cast("double").alias("c_nationkey"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"),
                                                           F.avg("o_totalprice").alias("avg_order"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        "c_custkey", "c_acctbal", "c_nationkey", F.coalesce("n_orders", F.lit(0.0)).alias("n_orders"),
        F.coalesce("avg_order", F.lit(0.0)).alias("avg_order"))


CLU_FEATURES = ["c_acctbal", "c_nationkey", "n_orders", "avg_order"]


def q_pca_report(spark, sf):
    """M2: explained / cumulative variance of standardised customer features."""
    rep, k, _ = unsupervised.pca_report(_cluster_input(spark, sf), CLU_FEATURES)
    return _round_doubles(rep.withColumn("chosen", F.col("component") <= k))


Q["pca_report"] = q_pca_report


@register("pca_pair", """WITH r AS (SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer)
SELECT 1 AS component, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM r
UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0 FROM r""")
def q_pca_pair(spark, sf):
    """M2 on two features, where the variance shares have a closed form."""
    c = table(spark, sf, "customer")
    return _round_doubles(unsupervised.component_space(c, ["c_acctbal", "c_nationkey"], "c_custkey").report)


def q_unsupervised_flow(spark, sf):
    """M1 to M7 as one run: k-means 2..8 and DBSCAN on the chosen components; every customer in the
    two-component view with its cluster in the best model, its name and silhouette."""
    from kiln.plans.prepare import run_unsupervised
    run = run_unsupervised(_cluster_input(spark, sf), "c_custkey")
    return _round_doubles(run["view"].withColumns({"model": F.lit(run["best"]), "silhouette": F.lit(run["silhouette"]).cast("double"),
                                                   "components": F.lit(run["components"])}))


Q["unsupervised_flow"] = q_unsupervised_flow


@register("cluster_profiles", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS c_acctbal_mean,
  round(stddev_samp(c_acctbal), 6) AS c_acctbal_std, round(avg(c_nationkey), 6) AS c_nationkey_mean,
  round(stddev_samp(c_nationkey), 6) AS c_nationkey_std FROM customer GROUP BY c_mktsegment""")
def q_cluster_profiles(spark, sf):
    """O6 with the market segments as clusters."""
    return _round_doubles(unsupervised.cluster_profiles(table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]))


def q_kmeans_sweep(spark, sf):
    """M3 + O5 + M6: k = 2..8, best of 10 seeds each, inertia (elbow) and exact silhouette, ranked."""
    rows = unsupervised.kmeans_sweep(_cluster_input(spark, sf), CLU_FEATURES, "c_custkey", 2, 8, n_init=10)
    return _round_doubles(unsupervised.cluster_leaderboard(rows))


Q["kmeans_sweep"] = q_kmeans_sweep


def q_pca_2d_view(spark, sf):
    """M7: first two components of every customer, with the clusters of a divisive run as labels."""
    df = _cluster_input(spark, sf)
    labels = unsupervised.bisecting_kmeans(df, CLU_FEATURES, "c_custkey", k=4)
    return _round_doubles(unsupervised.pca_2d_view(df, CLU_FEATURES, "c_custkey", labels))


Q["pca_2d_view"] = q_pca_2d_view


def q_bisecting(spark, sf):
    """O11 + O6: divisive clustering and per-cluster feature profiles."""
    df = _cluster_input(spark, sf)
    lab = unsupervised.bisecting_kmeans(df, CLU_FEATURES, "c_custkey", k=4)
    return _round_doubles(unsupervised.cluster_profiles(df.join(lab, "c_custkey"), "cluster", CLU_FEATURES))


Q["bisecting_kmeans"] = q_bisecting


def q_dbscan_customers(spark, sf):
    """M4 + M5 + M6 on customers: cluster count, exact silhouette (noise counted as a cluster)."""
    df = _cluster_input(spark, sf)
    lab = unsupervised.dbscan_run(df, CLU_FEATURES, "c_custkey", eps=0.8, min_samples=5)
    n_clusters, sil = unsupervised.dbscan_summary(lab, df, CLU_FEATURES, "c_custkey")
    return _round_doubles(spark.createDataFrame([("DBSCAN", n_clusters, None if sil is None else float(sil))],
                                                "Model string, n_clusters int, silhouette double"))


Q["dbscan_customers"] = q_dbscan_customers


# ---- A5-A7: sinks ------------------------------------------------------------------------------------

def _scratch(spark, name):
    """A folder next to the shared checkpoint folder (never a machine-local temp dir on a cluster)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/kiln-out/{name}-{uuid.uuid4().hex}"


@register("write_read_csv", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_write_read_csv(spark, sf):
    """A5 + A1: export as CSV with header, read back with NA tokens and whole-table type inference."""
    path = _scratch(spark, "customer-csv")
    io.write_table(table(spark, sf, "customer"), path, fmt="csv")
    back = io.read_table(spark, path, fmt="csv")
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                       F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@register("csv_round_trip", """SELECT CAST(doc_id AS BIGINT) AS id, text FROM documents
UNION ALL SELECT CAST(event_id AS BIGINT), CAST(props AS VARCHAR) FROM events""")
def q_csv_round_trip(spark, sf):
    """A5 + A1 on texts with commas, quotes and line breaks."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    events = table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("id"), F.col("props").cast("string").alias("text"))
    path = _scratch(spark, "texts-csv")
    io.write_table(docs.unionByName(events), path, fmt="csv")
    return io.read_table(spark, path, fmt="csv", na_values=[]).select(F.col("id").cast("bigint").alias("id"), "text")


@register("write_report", """SELECT 'class_' || CAST(quality AS VARCHAR) AS Model, CAST(count(*) AS DOUBLE) AS F1
FROM labels GROUP BY quality""")
def q_write_report(spark, sf):
    """A small per-class table written as one CSV file and read back."""
    path = _scratch(spark, "report")
    lab = table(spark, sf, "labels").groupBy("quality").count()
    rep = lab.select(F.concat(F.lit("class_"), F.col("quality").cast("string")).alias("Model"),
                     F.col("count").cast("double").alias("F1"))
    io.write_report(rep, path)
    return spark.read.option("header", True).schema("Model string, F1 double").csv(path)




def q_save_load_model(spark, sf):
    """Save the fitted pipeline, load it back, predict with the loaded copy."""
    tr, te = _cls_split(spark, sf)
    spec = _specs("classification", ["Logistic Regression"], tr.count())[0]
    model, _ = models.fit_predict(spec, {}, tr, te, CLS_FEATURES, "StandardScaler")
    path = _scratch(spark, "model")
    io.save_model(model, path)
    loaded = io.load_model(path)
    return loaded.transform(te).select("doc_id", "label", "prediction",
                                       vector_to_array("probability").alias("probability"))


Q["save_load_model"] = q_save_load_model


def q_prepare_lineitem(spark, sf):
    """Steps 2-11 end to end on lineitem with injected NULLs: IDs, auto fill, duplicates, IQR cap,
    encoding (target protected), zero-variance and correlation filters (rows-only)."""
    from kiln.plans.prepare import PrepConfig, prepare
    df = lineitem_nulls(spark, sf)
    prep = prepare(df, PrepConfig(), target="l_returnflag", order_by="l_orderkey")
    return _round_doubles(prep.data)


Q["prepare_lineitem"] = q_prepare_lineitem
