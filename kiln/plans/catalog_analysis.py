"""Registered queries E-H (bivariate, outliers, encoding, selection) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import bivariate, encode, outliers, select
from kiln.operators.bivariate import category_pairs
from kiln.plans.catalog_prep import _round_doubles
from kiln.plans.fixtures import (customer_bool_text, lineitem_nulls, lineitem_twin, supplier_const, table,
                                 with_views)

Q: dict = {}
O: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            O[name] = sql
        return fn
    return deco


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_long_sql(tbl, cols, diagonal=True, mirror=True, pos=False):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j <= i:
                continue
            r = (f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END")
            parts.append((a, b, i, j, r))
    sel = []
    for a, b, i, j, r in parts:
        sel.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS pos_a, {j} AS pos_b, {r} AS r FROM {tbl}")
        if mirror:
            sel.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {j} AS pos_a, {i} AS pos_b, {r} AS r FROM {tbl}")
    if diagonal:
        for i, a in enumerate(cols):
            sel.append(f"SELECT '{a}', '{a}', {i}, {i}, CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END FROM {tbl}")
    return "(" + "\nUNION ALL\n".join(sel) + ")"


@register("corr_pairs", f"SELECT col_a, col_b, round(r, 6) AS r FROM {_corr_long_sql('lineitem', LI_NUM)}")
def q_corr_pairs(spark, sf):
    return _round_doubles(bivariate.corr_long(table(spark, sf, "lineitem"), LI_NUM).select("col_a", "col_b", "r"))


@register("corr_strength", f"""SELECT col_a AS column_name, round(avg(abs(r)), 6) AS mean_abs_r
FROM {_corr_long_sql('lineitem', LI_NUM, diagonal=False)} GROUP BY col_a""")
def q_corr_strength(spark, sf):
    return _round_doubles(bivariate.corr_strength(table(spark, sf, "lineitem"), LI_NUM))


@register("top_corr_pairs", f"""SELECT col_a, col_b, round(r, 6) AS r
FROM {_corr_long_sql('lineitem', LI_NUM, diagonal=False, mirror=False)} WHERE r IS NOT NULL
ORDER BY abs(r) DESC, pos_a, pos_b LIMIT 4""")
def q_top_corr_pairs(spark, sf):
    return _round_doubles(bivariate.top_corr_pairs(table(spark, sf, "lineitem"), LI_NUM, 4))


@register("corr_unstacked", f"""SELECT col_a, col_b, round(r, 6) AS r
FROM {_corr_long_sql('lineitem', LI_NUM)} WHERE r IS NOT NULL ORDER BY r DESC, pos_a, pos_b LIMIT 10""")
def q_corr_unstacked(spark, sf):
    return _round_doubles(bivariate.corr_unstacked(table(spark, sf, "lineitem"), LI_NUM, 10))


@register("trend_line", """SELECT regr_count(l_extendedprice, l_quantity) AS n,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def q_trend_line(spark, sf):
    return _round_doubles(bivariate.trend_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("sample_rows", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)) LIMIT 1000""")
def q_sample_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return bivariate.sample_rows(o, ["o_orderkey"], 1000, 42)


@register("scatter_sample", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
ORDER BY md5('42|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)) LIMIT 1000""")
def q_scatter_sample(spark, sf):
    return bivariate.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                                    ["l_orderkey", "l_linenumber"], 1000, 42)


@register("scatter_points", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def q_scatter_points(spark, sf):
    return bivariate.scatter_sample(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber"])


TOP12_BRANDS = """(SELECT p_brand FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
                  ORDER BY count(*) DESC, p_brand ASC LIMIT 12)"""


@register("mean_by_category", f"""SELECT p_brand, round(avg(p_retailprice), 6) AS mean_value FROM part
WHERE p_brand IN {TOP12_BRANDS} GROUP BY p_brand""")
def q_mean_by_category(spark, sf):
    return _round_doubles(bivariate.mean_by_category(table(spark, sf, "part"), "p_brand", "p_retailprice", 12))


@register("box_by_category", """SELECT o_orderpriority, 'o_totalprice' AS column_name,
  round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  round(min(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END), 6)
    AS lower_whisker,
  round(max(CASE WHEN o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN o_totalprice END), 6)
    AS upper_whisker,
  count_if(o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM orders JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                         quantile_cont(o_totalprice, 0.5) AS med, quantile_cont(o_totalprice, 0.75) AS q3
                  FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)
WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority, q1, med, q3""")
def q_box_by_category(spark, sf):
    return _round_doubles(bivariate.box_by_category(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


def _kde_by_sql():
    from kiln.plans.catalog_prep import _kde_sql
    return _kde_sql("events", "value", by="event_type", top=12)


register("density_by_category", _kde_by_sql())(
    lambda spark, sf: _round_doubles(bivariate.density_by_category(table(spark, sf, "events"), "event_type",
                                                                   "value")))


@register("crosstab", """SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL""")
def q_crosstab(spark, sf):
    return bivariate.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_share", """SELECT l_returnflag, l_linestatus, n,
  round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM (
  SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem
  WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL)""")
def q_crosstab_share(spark, sf):
    return _round_doubles(bivariate.crosstab_share(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("category_pairs", """WITH u AS (SELECT count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b
FROM lineitem) SELECT 'l_returnflag' AS col_a, 'l_linestatus' AS col_b FROM u
WHERE a > 1 AND a <= 12 AND b > 1 AND b <= 12""")
def q_category_pairs(spark, sf):
    pairs = category_pairs(table(spark, sf, "lineitem"))
    return spark.createDataFrame(pairs, "col_a string, col_b string")


@register("group_mean_top", """SELECT p_brand, round(avg(p_retailprice), 6) AS mean_value FROM part
GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand ASC LIMIT 10""")
def q_group_mean_top(spark, sf):
    return _round_doubles(bivariate.group_mean_top(table(spark, sf, "part"), "p_brand", "p_retailprice", 10))


# ---- F: outliers -------------------------------------------------------------

@register("iqr_cap", """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
                            WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END, 6) AS value
FROM events, b""")
def q_iqr_cap(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return _round_doubles(outliers.fit_cap(ev, ["value"], "iqr").transform(ev))


@register("iqr_bounds", """SELECT column_name, round(q1 - 1.5 * (q3 - q1), 6) AS lo, round(q3 + 1.5 * (q3 - q1), 6) AS hi
FROM (SELECT 'value' AS column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events
      UNION ALL
      SELECT 'user_id', quantile_cont(user_id, 0.25), quantile_cont(user_id, 0.75) FROM events)""")
def q_iqr_bounds(spark, sf):
    b = outliers.iqr_bounds(table(spark, sf, "events"), ["value", "user_id"])
    return _round_doubles(spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in b.items()],
                                                "column_name string, lo double, hi double"))


@register("zscore_bounds", """SELECT column_name, round(m - 3 * s, 6) AS lo, round(m + 3 * s, 6) AS hi FROM (
  SELECT 'value' AS column_name, avg(value) AS m, stddev_samp(value) AS s FROM events
  UNION ALL SELECT 'user_id', avg(user_id), stddev_samp(user_id) FROM events) WHERE s > 0""")
def q_zscore_bounds(spark, sf):
    b = outliers.zscore_bounds(table(spark, sf, "events"), ["value", "user_id"])
    return _round_doubles(spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in b.items()],
                                                "column_name string, lo double, hi double"))


@register("zscore_remove", """WITH b1 AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo,
                                                 avg(value) + 3 * stddev_samp(value) AS hi FROM events),
s1 AS (SELECT e.* FROM events e, b1 WHERE coalesce(e.value >= b1.lo AND e.value <= b1.hi, true)),
b2 AS (SELECT avg(user_id) - 3 * stddev_samp(user_id) AS lo, avg(user_id) + 3 * stddev_samp(user_id) AS hi FROM s1),
s2 AS (SELECT s1.* FROM s1, b2 WHERE coalesce(s1.user_id >= b2.lo AND s1.user_id <= b2.hi, true))
SELECT event_id, user_id, value FROM s2""")
def q_zscore_remove(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    out, _ = outliers.remove_outliers(ev, ["value", "user_id"], method="zscore")
    return out


@register("zscore_inlier_bounds", """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events)
SELECT 'value' AS column_name, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events, s
WHERE abs((value - m) / sd) <= 3""")
def q_zscore_inlier(spark, sf):
    b = outliers.zscore_inlier_bounds(table(spark, sf, "events"), ["value"])
    return _round_doubles(spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in b.items()],
                                                "column_name string, lo double, hi double"))


@register("outlier_log", """WITH b AS (
  SELECT 'value' AS column_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events
  UNION ALL SELECT 'user_id', quantile_cont(user_id, 0.25), quantile_cont(user_id, 0.75) FROM events),
c AS (SELECT b.column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
             count_if(CASE b.column_name WHEN 'value' THEN e.value ELSE e.user_id END < q1 - 1.5 * (q3 - q1)
                   OR CASE b.column_name WHEN 'value' THEN e.value ELSE e.user_id END > q3 + 1.5 * (q3 - q1))
               AS n_outliers, count(*) AS n
      FROM b, events e GROUP BY ALL)
SELECT column_name, n_outliers, 'clipped' AS action, round(lo, 6) AS lo, round(hi, 6) AS hi,
       n AS rows_before, n AS rows_after FROM c WHERE n_outliers > 0""")
def q_outlier_log(spark, sf):
    p = outliers.fit_cap(table(spark, sf, "events"), ["value", "user_id"], "iqr")
    return _round_doubles(p.log_frame(spark))


# ---- G: encoding -------------------------------------------------------------

def _sk(e):
    return f"CASE WHEN count({e}) >= 3 THEN coalesce(skewness({e}), 0) END"


@register("skewed_columns", f"""SELECT column_name, round(skew, 6) AS skew FROM (
  SELECT 'event_id' AS column_name, {_sk('event_id')} AS skew FROM events
  UNION ALL SELECT 'user_id', {_sk('user_id')} FROM events
  UNION ALL SELECT 'value', {_sk('value')} FROM events) WHERE abs(skew) > 0.75""")
def q_skewed_columns(spark, sf):
    return _round_doubles(encode.skewed_columns(table(spark, sf, "events"), ["event_id", "user_id", "value"]))


@register("signed_log", """SELECT event_id, value, round(sign(value) * ln(1 + abs(value)), 6) AS value_log
FROM events""")
def q_signed_log(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return _round_doubles(encode.add_signed_log(ev, ["value"]))


@register("bool_to_int", "SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS c_positive FROM customer")
def q_bool_to_int(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("c_positive"))
    return encode.bool_to_int(c)


@register("label_encode_first", """WITH codes AS (
  SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS DOUBLE) AS code
  FROM events WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT e.event_id, c.code AS event_type FROM events e LEFT JOIN codes c USING (event_type)""")
def q_label_encode_first(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    return encode.label_encode(ev, "event_type", "event_id")


@register("label_encode_sorted", with_views("lineitem_nulls") + """,
v AS (SELECT coalesce(l_returnflag, 'nan') AS k FROM lineitem_nulls GROUP BY 1),
codes AS (SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS DOUBLE) AS code FROM v)
SELECT l_orderkey, l_linenumber, codes.code AS l_returnflag
FROM lineitem_nulls JOIN codes ON coalesce(l_returnflag, 'nan') = codes.k""")
def q_label_encode_sorted(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    return encode.label_encode_sorted(df, "l_returnflag")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot_segment", "SELECT c_custkey, c_acctbal, " + ", ".join(
    f"CAST(coalesce(c_mktsegment = '{v}', false) AS INTEGER) AS \"c_mktsegment_{v}\"" for v in SEGMENTS[1:])
    + " FROM customer")
def q_one_hot_segment(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return encode.one_hot(c, "c_mktsegment")


@register("frequency_encode_brand", """SELECT p_partkey, round(f, 6) AS p_brand_freq FROM part LEFT JOIN (
  SELECT p_brand, count(*) / (SELECT count(p_brand) FROM part) AS f FROM part WHERE p_brand IS NOT NULL
  GROUP BY p_brand) USING (p_brand)""")
def q_frequency_encode_brand(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return _round_doubles(encode.frequency_encode(p, "p_brand"))


@register("encode_both", """WITH codes AS (
  SELECT l_linestatus, CAST(row_number() OVER (ORDER BY min(l_orderkey), l_linestatus) - 1 AS DOUBLE) AS code
  FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_linestatus)
SELECT l_orderkey, l_linenumber, c.code AS l_linestatus FROM lineitem LEFT JOIN codes c USING (l_linestatus)""")
def q_encode_both(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return encode.encode_both(li, "l_linestatus", "l_orderkey")


@register("boollike_text", with_views("customer_bool_text") + """
SELECT c_custkey, CASE lower(trim(c_flag)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 WHEN 'true' THEN 1.0
  WHEN 'false' THEN 0.0 WHEN 'y' THEN 1.0 WHEN 'n' THEN 0.0 WHEN 't' THEN 1.0 WHEN 'f' THEN 0.0
  WHEN '1' THEN 1.0 WHEN '0' THEN 0.0 END::DOUBLE AS c_flag FROM customer_bool_text""")
def q_boollike_text(spark, sf):
    c = customer_bool_text(spark, sf).select("c_custkey", "c_flag")
    return encode.boollike_text(c, "c_flag")


@register("datetime_to_epoch", """SELECT o_orderkey, round(epoch_us(o_orderdate) / 1e6, 6) AS o_orderdate
FROM orders""")
def q_datetime_to_epoch(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return _round_doubles(encode.datetime_to_epoch(o))


@register("factorize", """WITH codes AS (
  SELECT p_type, CAST(row_number() OVER (ORDER BY min(p_partkey), p_type) - 1 AS DOUBLE) AS code
  FROM part WHERE p_type IS NOT NULL GROUP BY p_type)
SELECT p_partkey, c.code AS p_type FROM part LEFT JOIN codes c USING (p_type)""")
def q_factorize(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return encode.label_encode(p, "p_type", "p_partkey")


def _encode_table_spark(spark, sf):
    c = table(spark, sf, "customer")
    params = encode.fit_encode_table(c, method="auto", order_by="c_custkey")
    return c, params


@register("encode_table", """SELECT c_custkey, c_nationkey, c_acctbal, """ + ", ".join(
    f"CAST(coalesce(c_mktsegment = '{v}', false) AS INTEGER) AS \"c_mktsegment_{v}\"" for v in SEGMENTS[1:]) +
    """, round(f, 6) AS c_name_freq FROM customer LEFT JOIN (
  SELECT c_name, count(*) / (SELECT count(c_name) FROM customer) AS f FROM customer WHERE c_name IS NOT NULL
  GROUP BY c_name) USING (c_name)""")
def q_encode_table(spark, sf):
    c, params = _encode_table_spark(spark, sf)
    return _round_doubles(params.transform(c))


@register("encoding_report", """SELECT 'c_name' AS column_name, 'Frequency Encoding (High Cardinality)' AS strategy
UNION ALL SELECT 'c_mktsegment', 'One-Hot Encoding (Low Cardinality)'""")
def q_encoding_report(spark, sf):
    _, params = _encode_table_spark(spark, sf)
    return params.report(spark)


@register("binarise_label", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus
FROM orders""")
def q_binarise_label(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.binarise_label(o, "o_orderstatus", "F")


@register("age_from_year", """SELECT o_orderkey, 2024 - CAST(year(o_orderdate) AS INTEGER) AS o_age FROM orders""")
def q_age_from_year(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    return encode.age_from_year(o, "o_year", 2024, out="o_age")


@register("ordinal_encode", """WITH b AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code
  FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand),
t AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS code
  FROM part WHERE p_type IS NOT NULL GROUP BY p_type)
SELECT p_partkey, b.code AS p_brand, t.code AS p_type FROM part LEFT JOIN b USING (p_brand) LEFT JOIN t USING (p_type)""")
def q_ordinal_encode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return encode.ordinal_encode(p, ["p_brand", "p_type"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot_full", "SELECT o_orderkey, " + ", ".join(
    f"CAST(coalesce(o_orderpriority = '{v}', false) AS INTEGER) AS \"o_orderpriority_{v}\"" for v in PRIORITIES)
    + " FROM orders")
def q_one_hot_full(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.one_hot_full(o, ["o_orderpriority"])


def q_yeo_johnson(spark, sf):
    """G16 (no SQL twin: lambda is a maximum-likelihood search)."""
    ev = table(spark, sf, "events").select("event_id", "value", "user_id")
    p = encode.fit_yeo_johnson(ev, ["value", "user_id"])
    return _round_doubles(p.transform(ev))


Q["yeo_johnson"] = q_yeo_johnson

YJ_GIVEN = {"half": 0.5, "zero": 0.0, "two": 2.0, "minus": -1.0}


def _yj_sql(lam):
    pos = "ln(1 + c_acctbal)" if lam == 0 else f"(power(c_acctbal + 1, {lam}) - 1) / ({lam})"
    neg = "-ln(1 - c_acctbal)" if lam == 2 else f"-(power(1 - c_acctbal, {2 - lam}) - 1) / ({2 - lam})"
    return f"round(CASE WHEN c_acctbal >= 0 THEN {pos} ELSE {neg} END / 1000, 6)"


@register("yeo_johnson_given", "SELECT c_custkey, " + ", ".join(f"{_yj_sql(lam)} AS {c}" for c, lam in YJ_GIVEN.items()) + " FROM customer")
def q_yeo_johnson_given(spark, sf):
    """G16's transform at given exponents, the logarithms among them."""
    c = table(spark, sf, "customer").select("c_custkey", *[F.col("c_acctbal").alias(n) for n in YJ_GIVEN])
    p = encode.YeoJohnsonParams(YJ_GIVEN, dict.fromkeys(YJ_GIVEN, 0.0), dict.fromkeys(YJ_GIVEN, 1000.0))
    return _round_doubles(p.transform(c))


def q_column_transformer(spark, sf):
    """Ordinal + one-hot + Yeo-Johnson + standard scaling into one vector (rows-only check)."""
    from pyspark.ml.functions import vector_to_array
    c = table(spark, sf, "customer").withColumn("c_flag", F.when(F.col("c_acctbal") > 0, "Y").otherwise("N"))
    pipe = encode.column_transformer({"onehot": ["c_mktsegment"], "ordinal": ["c_flag"],
                                      "power": ["c_acctbal"], "standard": ["c_nationkey", "c_acctbal"]})
    out = pipe.fit(c).transform(c)
    return out.select("c_custkey", vector_to_array("features").alias("features"))


Q["column_transformer"] = q_column_transformer


# ---- H: selection -------------------------------------------------------------

@register("drop_zero_variance", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_drop_zero_variance(spark, sf):
    return select.drop_zero_variance(supplier_const(spark, sf))


@register("variance_select_matrix", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_variance_select(spark, sf):
    return select.variance_select_matrix(supplier_const(spark, sf))


TWIN = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_price2"]


@register("corr_filter", with_views("lineitem_twin") + f"""
SELECT col_b AS column_name, pos_b AS position, round(max(abs(r)), 6) AS max_abs_r_earlier,
       coalesce(max(abs(r)) > 0.95, false) AS dropped
FROM {_corr_long_sql('lineitem_twin', TWIN, diagonal=False, mirror=False)} GROUP BY col_b, pos_b""")
def q_corr_filter(spark, sf):
    return _round_doubles(select.corr_filter_report(lineitem_twin(spark, sf), TWIN, 0.95))


@register("corr_filter_apply", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
                               "FROM lineitem")
def q_corr_filter_apply(spark, sf):
    df = lineitem_twin(spark, sf).select("l_orderkey", "l_linenumber", *TWIN)
    return select.corr_filter(df, TWIN, 0.95)


@register("corr_matrix", "SELECT col_a, " + ", ".join(
    f"round(max(CASE WHEN col_b = '{c}' THEN r END), 6) AS {c}" for c in LI_NUM) +
    f" FROM {_corr_long_sql('lineitem', LI_NUM)} GROUP BY col_a")
def q_corr_matrix(spark, sf):
    """E1 as a square matrix: one row per column, one column per column."""
    return _round_doubles(bivariate.corr_matrix(table(spark, sf, "lineitem"), LI_NUM))
