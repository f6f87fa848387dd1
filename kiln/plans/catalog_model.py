"""Registered queries I-M, O and B11-B14 (split, scale, metrics, neighbours, models,
clustering, specification extras, text rules) with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import evaluate, extras, models, neighbours, scale, silhouette, split, textrules
from kiln.plans.catalog_prep import _round_doubles
from kiln.plans.fixtures import table

Q: dict = {}
O: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


MD5_ORDER = "md5('42|' || CAST({k} AS VARCHAR))"

# ---- I: split / folds / balance ------------------------------------------------------------


@register("split_random", f"""SELECT o_orderkey,
  row_number() OVER (ORDER BY {MD5_ORDER.format(k='o_orderkey')}) <= (SELECT ceil(count(*) * 0.2::DOUBLE) FROM orders)
    AS is_test FROM orders""")
def q_split_random(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return split.split_flags(o, ["o_orderkey"], 0.2, 42).select("o_orderkey", "is_test")


STRAT_SQL = f"""WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus),
tot AS (SELECT sum(n) AS n, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS t FROM c),
a AS (SELECT c.o_orderstatus, (c.n * tot.t) // tot.n AS base, (c.n * tot.t) % tot.n AS rem, tot.t FROM c, tot),
r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, o_orderstatus) AS rr,
             t - sum(base) OVER () AS extra FROM a),
k AS (SELECT o_orderstatus, base + CASE WHEN rr <= extra THEN 1 ELSE 0 END AS k FROM r)
SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {MD5_ORDER.format(k='o_orderkey')}) <= k.k AS is_test
FROM orders JOIN k USING (o_orderstatus)"""


@register("split_stratified", STRAT_SQL)
def q_split_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.split_flags(o, ["o_orderkey"], 0.2, 42, stratify="o_orderstatus")


LINE_ORDER = "md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR))"


@register("split_stratified_parts", f"""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n) * 0.2::DOUBLE) AS BIGINT) AS t FROM c),
a AS (SELECT c.l_partkey, (c.n * tot.t) // tot.n AS base, (c.n * tot.t) % tot.n AS rem, tot.t FROM c, tot),
r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, CAST(l_partkey AS VARCHAR)) AS rr, t - sum(base) OVER () AS extra FROM a),
k AS (SELECT l_partkey, base + CASE WHEN rr <= extra THEN 1 ELSE 0 END AS k FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER}) <= k.k AS is_test
FROM lineitem JOIN k USING (l_partkey)""")
def q_split_stratified_parts(spark, sf):
    """I2 with as many classes as there are parts (200,000 x scale factor)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return split.split_flags(li, ["l_orderkey", "l_linenumber"], 0.2, 42, stratify="l_partkey")


@register("assign_folds_parts", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CAST((row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER}) - 1) % 5 AS INTEGER) AS fold FROM lineitem""")
def q_assign_folds_parts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return split.assign_folds(li, 5, ["l_orderkey", "l_linenumber"], stratify="l_partkey")


@register("assign_folds", f"""SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY {MD5_ORDER.format(k='doc_id')}) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def q_assign_folds(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return split.assign_folds(lab, 5, ["doc_id"], stratify="quality")


@register("class_balance", """WITH c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1)
SELECT class, n, round((SELECT min(n) FROM c) / (SELECT max(n) FROM c), 6) AS ratio,
  (SELECT min(n) FROM c) / (SELECT max(n) FROM c) < 0.6 AND (SELECT min(n) FROM c) >= 2 AS resample FROM c""")
def q_class_balance(spark, sf):
    return _round_doubles(split.class_balance(table(spark, sf, "labels"), "quality"))


@register("fold_count", """SELECT CAST(CASE WHEN least(5, count(*), (SELECT min(n) FROM (SELECT count(*) AS n
  FROM labels GROUP BY quality))) >= 2 THEN least(5, count(*), (SELECT min(n) FROM (SELECT count(*) AS n FROM labels
  GROUP BY quality))) ELSE 0 END AS INTEGER) AS folds FROM labels""")
def q_fold_count(spark, sf):
    k = split.fold_count(table(spark, sf, "labels"), 5, "quality")
    return spark.createDataFrame([(int(k),)], "folds int")


# ---- J: scaling ------------------------------------------------------------------------------

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sk(c):
    return f"CASE WHEN count({c}) >= 3 THEN coalesce(skewness({c}), 0) END"


@register("choose_scaler", "SELECT CASE WHEN median(s) > 1.0 THEN 'MinMaxScaler' ELSE 'StandardScaler' END AS scaler "
          "FROM (" + " UNION ALL ".join(f"SELECT abs({_sk(c)}) AS s FROM lineitem" for c in LI_NUM) + ")")
def q_choose_scaler(spark, sf):
    s = scale.choose_scaler(table(spark, sf, "lineitem"), LI_NUM)
    return spark.createDataFrame([(s,)], "scaler string")


TRAIN_CUSTOMER = f"""train AS (SELECT * FROM customer QUALIFY row_number() OVER (ORDER BY
  {MD5_ORDER.format(k='c_custkey')}) > (SELECT ceil(count(*) * 0.2::DOUBLE) FROM customer))"""


@register("standard_scale", f"""WITH {TRAIN_CUSTOMER},
s AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn
      FROM train)
SELECT c_custkey, round((c_acctbal - ma) / sa, 6) AS c_acctbal, round((c_nationkey - mn) / sn, 6) AS c_nationkey
FROM customer, s""")
def q_standard_scale(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    tr, _ = split.split_random(c, ["c_custkey"], 0.2, 42)
    p = scale.fit_scaler(tr, ["c_acctbal", "c_nationkey"], scale.STANDARD)
    return _round_doubles(p.transform(c))


@register("minmax_scale", f"""WITH {TRAIN_CUSTOMER},
s AS (SELECT min(c_acctbal) AS a1, max(c_acctbal) - min(c_acctbal) AS r1,
             min(c_nationkey) AS a2, max(c_nationkey) - min(c_nationkey) AS r2 FROM train)
SELECT c_custkey, round((c_acctbal - a1) / r1, 6) AS c_acctbal, round((c_nationkey - a2) / r2, 6) AS c_nationkey
FROM customer, s""")
def q_minmax_scale(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    tr, _ = split.split_random(c, ["c_custkey"], 0.2, 42)
    p = scale.fit_scaler(tr, ["c_acctbal", "c_nationkey"], scale.MINMAX)
    return _round_doubles(p.transform(c))


# ---- L: metrics (labels: quality = actual, toxic = predicted) ----------------------------------

def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"),
                                             F.col("toxic").alias("prediction"))


@register("confusion_report", """SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL""")
def q_confusion(spark, sf):
    return evaluate.confusion_matrix(_labels(spark, sf))


PER_CLASS_SQL = """pc AS (
  SELECT c.cls, coalesce(a.support, 0) AS support, coalesce(p.n_pred, 0) AS n_pred, coalesce(t.tp, 0) AS tp
  FROM (SELECT quality AS cls FROM labels UNION SELECT toxic FROM labels) c
  LEFT JOIN (SELECT quality AS cls, count(*) AS support FROM labels GROUP BY 1) a USING (cls)
  LEFT JOIN (SELECT toxic AS cls, count(*) AS n_pred FROM labels GROUP BY 1) p USING (cls)
  LEFT JOIN (SELECT quality AS cls, count(*) AS tp FROM labels WHERE quality = toxic GROUP BY 1) t USING (cls)),
m AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
      FROM m)"""


@register("classification_metrics", f"""WITH {PER_CLASS_SQL}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
FROM f""")
def q_classification_metrics(spark, sf):
    return _round_doubles(evaluate.classification_metrics(_labels(spark, sf)))


@register("classification_report", f"""WITH {PER_CLASS_SQL}
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM f WHERE support > 0
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM f WHERE support > 0
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM f WHERE support > 0""")
def q_classification_report(spark, sf):
    return _round_doubles(evaluate.classification_report(_labels(spark, sf)))


@register("roc_auc", """WITH s AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality = 1 AS pos
  FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT score, count_if(pos) AS p, count_if(NOT pos) AS n FROM s GROUP BY score),
c AS (SELECT score, p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS nb FROM g)
SELECT round(sum(p * nb + 0.5 * p * n) / (sum(p) * sum(n)), 6) AS auc FROM c""")
def q_roc_auc(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return _round_doubles(evaluate.roc_auc_binary(lab, "quality", "n_chars", positive=1))


def _group_mean_pred(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    m = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("prediction"))
    return o.join(F.broadcast(m), "o_orderpriority").select("o_orderkey", F.col("o_totalprice").alias("label"),
                                                            "prediction")


GROUP_MEAN_SQL = """p AS (SELECT o_orderkey, o_totalprice AS label,
  avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS prediction FROM orders)"""


@register("regression_metrics", f"""WITH {GROUP_MEAN_SQL}
SELECT round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse,
       round(avg(abs(label - prediction)), 6) AS mae,
       round(1 - sum((label - prediction) * (label - prediction))
                 / (sum(label * label) - sum(label) * sum(label) / count(*)), 6) AS r2 FROM p""")
def q_regression_metrics(spark, sf):
    return _round_doubles(evaluate.regression_metrics(_group_mean_pred(spark, sf)))


@register("residuals", f"""WITH {GROUP_MEAN_SQL}
SELECT o_orderkey, round(label, 6) AS label, round(prediction, 6) AS prediction,
       round(label - prediction, 6) AS residual FROM p""")
def q_residuals(spark, sf):
    return _round_doubles(evaluate.residuals(_group_mean_pred(spark, sf)))


@register("binary_report", """WITH b AS (SELECT CAST(quality = 1 AS INTEGER) AS y, CAST(toxic = 1 AS INTEGER) AS p FROM labels),
m AS (SELECT count(*) AS n, count_if(y = p) AS ok, sum(y * p) AS tp, sum(p) AS pp, sum(y) AS ap FROM b),
r AS (SELECT ok / n AS accuracy, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision,
             CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS recall FROM m),
g AS (SELECT p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY p),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS nb FROM g)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
       round((SELECT sum(pos * nb + 0.5 * pos * neg) / (sum(pos) * sum(neg)) FROM c), 6) AS auc FROM r""")
def q_binary_report(spark, sf):
    return _round_doubles(evaluate.binary_report(_labels(spark, sf)))


# ---- K4 / O12 / M5: neighbours over the embeddings ------------------------------------------------

KNN_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
        AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id),
v AS (SELECT vec_id, label, count(*) AS votes FROM d WHERE rn <= 5 GROUP BY vec_id, label)
SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM v
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label ASC) = 1"""


@register("knn_vote", KNN_SQL)
def q_knn_vote(spark, sf):
    emb = table(spark, sf, "embeddings")
    return neighbours.knn_vote(emb, emb, 5, "vec_id", "embedding", "label", exclude_self=True)


@register("knn_regress", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
        AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(label), 6) AS prediction FROM d WHERE rn <= 5 GROUP BY vec_id""")
def q_knn_regress(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _round_doubles(neighbours.knn_regress(emb, emb, 5, "vec_id", "embedding", "label", exclude_self=True))


@register("silhouette", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
sz AS (SELECT label, count(*) AS n FROM e GROUP BY label),
s AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS sd
      FROM e a JOIN e b ON true GROUP BY ALL),
p AS (SELECT s.vec_id, s.own,
        max(CASE WHEN s.other = s.own THEN s.sd / (sz.n - 1) END) AS a,
        min(CASE WHEN s.other <> s.own THEN s.sd / sz.n END) AS b,
        max(CASE WHEN s.other = s.own THEN sz.n END) AS nc
      FROM s JOIN sz ON sz.label = s.other GROUP BY ALL)
SELECT round(avg(CASE WHEN nc <= 1 OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       count(DISTINCT own) AS n_clusters FROM p""")
def q_silhouette(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _round_doubles(silhouette.silhouette_exact(emb, "vec_id", "embedding", "label"))


@register("silhouette_squared", """WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x,
             generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, count(*) AS n, avg(x) AS mu, var_pop(x) AS v FROM e GROUP BY label, i),
d AS (SELECT e.vec_id, e.label AS own, m.label AS other, any_value(m.n) AS n, sum((e.x - m.mu) * (e.x - m.mu) + m.v) AS msd
      FROM e JOIN m ON m.i = e.i GROUP BY e.vec_id, e.label, m.label),
p AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN msd * n / (n - 1) END) AS a,
             min(CASE WHEN own <> other THEN msd END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette,
       (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters FROM p""")
def q_silhouette_squared(spark, sf):
    """M5 with squared distances: from the clusters' moments alone, no row meets another."""
    emb = table(spark, sf, "embeddings")
    return _round_doubles(silhouette.silhouette(emb, "vec_id", "embedding", "label", metric="squared"))


def q_smote(spark, sf):
    """I5 on labels joined to document length (rows-only: synthetic rows)."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    out = neighbours.smote(lab.select("doc_id", "n_chars", "toxic", "quality"), "quality", ["n_chars", "toxic"],
                           "doc_id", k=5, seed=42)
    return _round_doubles(out)


Q["smote"] = q_smote


def q_smote_enn(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    out = neighbours.smote_enn(lab.select("doc_id", "n_chars", "toxic", "quality"), "quality", ["n_chars", "toxic"],
                               "doc_id", k=5, seed=42)
    return _round_doubles(out)


Q["smote_enn"] = q_smote_enn


@register("dbscan", """WITH RECURSIVE e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY k),
z AS (SELECT vec_id, list(CASE WHEN s = 0 THEN 0 ELSE (x - m) / s END ORDER BY k) AS v FROM e JOIN st USING (k) GROUP BY vec_id),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON list_distance(a.v, b.v) <= 8.0),
core AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 5),
r AS (SELECT id AS node, id AS root FROM core UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node JOIN core ON core.id = p.b),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM c),
o AS (SELECT p.a AS node, min(cluster) AS cluster FROM p JOIN n ON n.node = p.b WHERE p.a NOT IN (SELECT id FROM core) GROUP BY p.a)
SELECT vec_id, CAST(coalesce(n.cluster, o.cluster, -1) AS INT) AS cluster FROM embeddings
LEFT JOIN n ON n.node = vec_id LEFT JOIN o ON o.node = vec_id""")
def q_dbscan(spark, sf):
    """M4 on the (standardised) embeddings, all elements: cluster per vector, noise -1."""
    from kiln.operators.unsupervised import dbscan_run
    emb = table(spark, sf, "embeddings")
    width = emb.agg(F.max(F.size("embedding"))).first()[0]
    feats = [f"e{i}" for i in range(width)]
    wide = emb.select("vec_id", *[F.get(F.col("embedding"), F.lit(i)).cast("double").alias(c) for i, c in enumerate(feats)])
    return dbscan_run(wide, feats, "vec_id", eps=8.0, min_samples=5)


KNN_MANHATTAN_SQL = KNN_SQL.replace("list_distance(a.v, b.v)", "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))")


@register("knn_vote_manhattan", KNN_MANHATTAN_SQL)
def q_knn_vote_manhattan(spark, sf):
    """K4 with the search list's other distance exponent."""
    emb = table(spark, sf, "embeddings")
    return neighbours.knn_vote(emb, emb, 5, "vec_id", "embedding", "label", exclude_self=True, metric="manhattan")


# ---- B11-B14: text rules ----------------------------------------------------------------------------

def _contains_sql(words):
    return " OR ".join(f"contains(t, '{w}')" for w in words)


@register("classify_problem_text", f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id,
  CASE WHEN ({_contains_sql(textrules.UNSUPERVISED_WORDS)}) AND NOT ({_contains_sql(textrules.SUPERVISED_WORDS)})
       THEN 'unsupervised' WHEN {_contains_sql(textrules.SUPERVISED_WORDS)} THEN 'supervised'
       ELSE 'unsupervised' END AS learning_type,
  CASE WHEN ({_contains_sql(textrules.REGRESSION_WORDS)}) AND NOT ({_contains_sql(textrules.CLASSIFICATION_WORDS)})
       THEN 'regression' WHEN {_contains_sql(textrules.CLASSIFICATION_WORDS)} THEN 'classification'
       ELSE 'classification' END AS task_type
FROM d""")
def q_classify_problem_text(spark, sf):
    return textrules.classify_problem_text(table(spark, sf, "documents"), "text", "doc_id")


def q_score_target_columns(spark, sf):
    """B12 over whole documents against the lineitem and orders column names (rows-only)."""
    cols = table(spark, sf, "lineitem").columns + table(spark, sf, "orders").columns + ["label", "quality", "value"]
    return textrules.score_target_columns(table(spark, sf, "documents"), "text", "doc_id", cols)


Q["score_target_columns"] = q_score_target_columns


def _sk_abs(c, t):
    return f"SELECT abs(CASE WHEN count({c}) >= 3 THEN coalesce(skewness({c}), 0) END) AS s FROM {t}"


def _iqr_out(c, t):
    return (f"SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS o FROM {t}, "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})")


RECO_SQL = """WITH t AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id)),
sk AS (""" + " UNION ALL ".join(_sk_abs(c, "t") for c in ("doc_id", "toxic", "n_chars")) + """),
oc AS (""" + " UNION ALL ".join(_iqr_out(c, "t") for c in ("doc_id", "toxic", "n_chars")) + """),
cls AS (SELECT count(*) AS n FROM t GROUP BY quality),
f AS (SELECT (SELECT median(s) FROM sk) AS ms, (SELECT max(o) FROM oc) / (SELECT count(*) FROM t) AS os,
             (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT lang) FROM t) AS ul,
             (SELECT min(n) FROM cls) / (SELECT max(n) FROM cls) AS ratio)
SELECT CASE WHEN ms < 0.5 THEN 'Fill — mean' ELSE 'Fill — median' END AS missing_strategy,
       CASE WHEN n < 1000 THEN 'IQR' ELSE 'Z-score' END AS outlier_method,
       CASE WHEN os < 0.05 THEN 'Cap (clip)' ELSE 'Remove rows' END AS outlier_action,
       CASE WHEN ul < 10 THEN 'One-Hot Encoding' ELSE 'Label Encoding' END AS encoding_method,
       CASE WHEN ratio >= 0.6 THEN 0.2 ELSE 0.3 END::DOUBLE AS test_size,
       round(ms, 6) AS median_abs_skew, round(os, 6) AS max_outlier_share FROM f"""


@register("recommend_config", RECO_SQL)
def q_recommend_config(spark, sf):
    """B14 on labels joined to documents: the decision rules from one set of aggregates."""
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return _round_doubles(textrules.recommend_config(df, "quality"))




def q_resolve_target(spark, sf):
    """B13 for every document text against the orders columns (rows-only: uses the B12 scorer)."""
    return textrules.resolve_target_texts(table(spark, sf, "documents"), "text", "doc_id",
                                          table(spark, sf, "orders"))


Q["resolve_target"] = q_resolve_target


# ---- O: specification extras --------------------------------------------------------------------------

@register("date_parts", """SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
  isodow(o_orderdate) - 1 AS o_orderdate_weekday FROM orders""")
def q_date_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = extras.date_parts(o, "o_orderdate").drop("o_orderdate")
    return out.select("o_orderkey", F.col("o_orderdate_year").cast("bigint").alias("o_orderdate_year"),
                      F.col("o_orderdate_month").cast("bigint").alias("o_orderdate_month"),
                      F.col("o_orderdate_weekday").cast("bigint").alias("o_orderdate_weekday"))


@register("equal_width_bins", """WITH s AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, CAST(least(floor((o_totalprice - mn) / ((mx - mn) / 10)), 9) AS INTEGER) AS o_totalprice_bin
FROM orders, s""")
def q_equal_width_bins(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return extras.equal_width_bins(o, "o_totalprice", 10).select("o_orderkey", "o_totalprice_bin")


@register("quantile_bins", """WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
  quantile_cont(o_totalprice, 0.75) AS c FROM orders)
SELECT o_orderkey, CAST((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= c)::INT AS INTEGER)
  AS o_totalprice_qbin FROM orders, s""")
def q_quantile_bins(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return extras.quantile_bins(o, "o_totalprice", 4).select("o_orderkey", "o_totalprice_qbin")


@register("interactions", """SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount
FROM lineitem""")
def q_interactions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return _round_doubles(extras.interactions(li, [("l_quantity", "l_discount")]).drop("l_quantity", "l_discount"))


@register("leakage_check", """WITH n AS (SELECT count(*) AS n FROM labels WHERE quality IS NOT NULL),
d AS (SELECT 'toxic' AS column_name, sum(m) AS s FROM (SELECT toxic, max(k) AS m FROM (
        SELECT toxic, quality, count(*) AS k FROM labels WHERE quality IS NOT NULL GROUP BY ALL) GROUP BY toxic)
      UNION ALL
      SELECT 'doc_id', sum(m) FROM (SELECT doc_id, max(k) AS m FROM (
        SELECT doc_id, quality, count(*) AS k FROM labels WHERE quality IS NOT NULL GROUP BY ALL) GROUP BY doc_id)),
r AS (SELECT 'toxic' AS column_name, abs(corr(quality, toxic)) AS r FROM labels
      UNION ALL SELECT 'doc_id', abs(corr(quality, doc_id)) FROM labels)
SELECT d.column_name, round(r.r, 6) AS abs_r, round(d.s / n.n, 6) AS determinism,
       r.r >= 0.98 OR d.s / n.n >= 0.98 AS suspect FROM d JOIN r USING (column_name), n""")
def q_leakage_check(spark, sf):
    return _round_doubles(extras.leakage_check(table(spark, sf, "labels"), "quality", ["toxic", "doc_id"]))


def q_vif(spark, sf):
    """Variance inflation factors of the lineitem numerics (rows-only: a matrix inverse)."""
    return _round_doubles(extras.vif(table(spark, sf, "lineitem"), LI_NUM))


Q["vif"] = q_vif


# every third price is not a number any more, so that the share lies between none and all
REPAIR_COLS = {"o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority", "price": "CAST(o_totalprice AS STRING)",
               "day": "CAST(o_orderdate AS STRING)", "mixed": "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END"}


@register("type_repair", "WITH t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in REPAIR_COLS.items()) + " FROM orders)," + """
s AS (""" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, count(TRY_CAST({c} AS DOUBLE)) / count({c}) AS numeric_share,
  count(TRY_CAST({c} AS TIMESTAMP)) / count({c}) AS timestamp_share FROM t""" for c in REPAIR_COLS) + """)
SELECT column_name, round(numeric_share, 6) AS numeric_share, round(timestamp_share, 6) AS timestamp_share,
       CASE WHEN numeric_share >= 0.95 THEN 'double' WHEN timestamp_share >= 0.95 THEN 'timestamp' ELSE 'string' END AS suggested FROM s""")
def q_type_repair(spark, sf):
    o = table(spark, sf, "orders").selectExpr(*[f"{e} AS {c}" for c, e in REPAIR_COLS.items()])
    return _round_doubles(extras.type_repair_report(o))


@register("linear_regression_line", """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
def q_linear_regression_line(spark, sf):
    """K6 with one feature, where the fit has a closed form."""
    from pyspark.ml.feature import VectorAssembler
    rows = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows.where("l_quantity IS NOT NULL AND label IS NOT NULL"))
    spec = next(s for s in models.model_registry("regression", 1) if s.name == "Linear Regression")
    fit = spec.make().fit(rows)
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 3), round(float(fit.intercept), 3))], "slope double, intercept double")


@register("vif_pair", """WITH r AS (SELECT corr(o_totalprice, o_custkey) AS r FROM orders)
SELECT unnest(['o_totalprice', 'o_custkey']) AS column_name, round(1 / (1 - r * r), 6) AS vif FROM r""")
def q_vif_pair(spark, sf):
    """O7 on two columns, where the factor has a closed form."""
    return _round_doubles(extras.vif(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"]))


@register("anomaly_flags", """WITH s AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(user_id) AS mu,
  stddev_samp(user_id) AS su FROM events)
SELECT event_id, round(greatest(abs((value - mv) / sv), abs((user_id - mu) / su)), 6) AS anomaly_score,
  greatest(abs((value - mv) / sv), abs((user_id - mu) / su)) > 3 AS is_anomaly FROM events, s""")
def q_anomaly_flags(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "user_id")
    return _round_doubles(extras.anomaly_flags(ev, ["value", "user_id"]).select("event_id", "anomaly_score",
                                                                                 "is_anomaly"))


@register("roc_auc_ovr", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id)
        AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id),
v AS (SELECT vec_id, label AS cls, count(*) / 5.0 AS share FROM d WHERE rn <= 5 GROUP BY ALL),
c AS (SELECT DISTINCT label AS cls FROM embeddings),
s AS (SELECT e.vec_id, c.cls, coalesce(v.share, 0.0) AS score, e.label = c.cls AS is_pos
      FROM e JOIN c ON true LEFT JOIN v ON v.vec_id = e.vec_id AND v.cls = c.cls),
g AS (SELECT cls, score, count_if(is_pos) AS pos, count_if(NOT is_pos) AS neg FROM s GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS nb FROM g),
a AS (SELECT cls, sum(pos * nb + 0.5 * pos * neg) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS support FROM r GROUP BY cls)
SELECT round(sum(auc * support) / sum(support), 6) AS auc FROM a""")
def q_roc_auc_ovr(spark, sf):
    """L2 multi-class: leave-one-out 5-NN vote shares as class scores, one-vs-rest AUC weighted by support."""
    emb = table(spark, sf, "embeddings")
    cand = neighbours.knn_candidates(emb, emb, 5, "vec_id", "vec_id", "embedding", "label", exclude_self=True)
    votes = cand.groupBy(F.col("_qid").alias("vec_id"), F.col("_tlabel").alias("class")).agg(
        (F.count(F.lit(1)) / 5.0).alias("score"))
    classes = sorted(r[0] for r in emb.select("label").distinct().collect())  # bounded: the class list
    rows = emb.select("vec_id", "label", F.explode(F.array(*[F.lit(float(c)) for c in classes])).alias("class"))
    long = rows.join(votes, ["vec_id", "class"], "left").select(
        "vec_id", "class", F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.col("label").cast("double") == F.col("class")).alias("is_pos"))
    return _round_doubles(evaluate.roc_auc_ovr_long(long))
