"""Registered queries A-D (sources, profiling, cleaning, univariate) and their DuckDB oracles.

Every query reads whole driver tables (or views Spark derives from them);
doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.exprs import finite, rround, skew_sample
from kiln.operators import clean, profile, univariate
from kiln.operators.encode import fit_frequency
from kiln.operators.outliers import fit_cap
from kiln.plans.fixtures import (events_dups, events_nulls, lineitem_allnull, lineitem_nulls, orders_mostly_null,
                                 table, with_views)
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


def _round_doubles(df, digits=6):
    return df.select(*[rround(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.simpleString() in
                       ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields])


# ---- flagship -------------------------------------------------------------

def profile_and_clean_events(spark, sf):
    """Scan -> NULLs in value -> median fill -> IQR cap -> frequency-encode event_type -> report."""
    ev = events_nulls(spark, sf).select("event_id", "event_type", "value")
    filled = clean.fit_fill(ev, "median", ["value"]).transform(ev)
    capped = fit_cap(filled, ["value"], "iqr").transform(filled)
    lk = fit_frequency(capped, "event_type")
    enc = capped.withColumn("event_type_freq", lk.expr(F.col("event_type")))
    rep = enc.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_type_freq").alias("event_type_freq"),
        F.avg("value").alias("mean_value"), skew_sample(F.col("value")).alias("skew_value"))
    return _round_doubles(rep)


register("profile_and_clean_events", with_views("events_nulls") + """,
med AS (SELECT median(value) AS m FROM events_nulls),
filled AS (SELECT event_id, event_type, coalesce(value, (SELECT m FROM med)) AS value FROM events_nulls),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM filled),
capped AS (
  SELECT event_type,
         CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
              WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END AS value
  FROM filled, b),
freq AS (SELECT event_type, count(*) / (SELECT count(event_type) FROM capped) AS f
         FROM capped WHERE event_type IS NOT NULL GROUP BY event_type)
SELECT c.event_type, count(*) AS n, round(max(f.f), 6) AS event_type_freq,
       round(avg(c.value), 6) AS mean_value,
       round(CASE WHEN count(c.value) >= 3 THEN coalesce(skewness(c.value), 0) END, 6) AS skew_value
FROM capped c LEFT JOIN freq f ON c.event_type = f.event_type
GROUP BY c.event_type""")(profile_and_clean_events)


# ---- A: sources -------------------------------------------------------------

ORDERS_DATE_AS_TEXT = "CAST(o_orderdate AS VARCHAR) AS o_orderdate"


def _date_as_text(orders):
    return orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@register("read_table", f"SELECT * REPLACE ({ORDERS_DATE_AS_TEXT}) FROM orders")
def q_read_table(spark, sf):
    return _date_as_text(io.read_table(spark, f"{sf}/orders.parquet"))


@register("row_order", "SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_same FROM orders")
def q_row_order(spark, sf):
    """A3 with a generated id: one per row, and the same when the rows are read again."""
    rows = io.with_row_order(table(spark, sf, "orders"))
    again = rows.select("_row_id", F.col("o_orderkey").alias("_key"))
    return rows.join(again, "_row_id").agg(F.count("*").alias("n_rows"), F.countDistinct("_row_id").alias("n_ids"),
                                           F.count_if(F.col("o_orderkey") == F.col("_key")).alias("n_same"))


@register("normalise_missing", """
SELECT o_orderkey,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_num,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_num,
       o_totalprice AS totalprice
FROM orders""")
def q_normalise_missing(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", finite(F.substring("o_orderpriority", 1, 1)).alias("priority_num"),
                    finite(F.col("o_orderstatus")).alias("status_num"), finite(F.col("o_totalprice")).alias("totalprice"))


@register("preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10""")
def q_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return io.preview(io.with_row_order(o, by="o_orderkey"), 10, "o_orderkey")


@register("textual_view", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def q_textual_view(spark, sf):
    c = table(spark, sf, "customer")
    return io.textual_view(c, ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])


# ---- B: profiling -------------------------------------------------------------

@register("shape_census", with_views("lineitem_nulls") + """
SELECT count(*) AS n_rows, 11 AS n_cols, 8 AS n_numeric, 2 AS n_categorical,
       CAST(count_if(l_quantity IS NULL) + count_if(l_returnflag IS NULL) AS BIGINT) AS missing_cells,
       CAST((count_if(l_quantity IS NULL) > 0)::INT + (count_if(l_returnflag IS NULL) > 0)::INT AS INTEGER)
         AS missing_columns
FROM lineitem_nulls""")
def q_shape_census(spark, sf):
    return profile.shape_census(lineitem_nulls(spark, sf))


def _profile_sql(tbl, cols):
    parts = []
    for c, t in cols:
        parts.append(f"""SELECT '{c}' AS column_name, '{t}' AS dtype,
          round(count_if({c} IS NULL) * 100.0 / count(*), 3)::DOUBLE AS missing_pct,
          count(DISTINCT {c}) AS n_unique,
          round(count(DISTINCT {c}) / greatest(count(*), 1), 4)::DOUBLE AS unique_ratio FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]

register("profile_columns", _profile_sql("orders", ORDERS_TYPES))(
    lambda spark, sf: profile.profile_columns(table(spark, sf, "orders")))

LINEITEM_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                  ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                  ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                  ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]

register("table_info", with_views("lineitem_nulls") + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM lineitem_nulls"
    for c, t in LINEITEM_TYPES))(lambda spark, sf: profile.table_info(lineitem_nulls(spark, sf)))


def _describe_sql():
    nums = ["o_orderkey", "o_custkey", "o_totalprice"]
    cats = ["o_orderstatus", "o_orderpriority", "CAST(o_orderdate AS VARCHAR)"]
    parts = []
    for c in nums:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS count, CAST(NULL AS BIGINT) AS unique,
          CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
          round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
          round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
          round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c})::DOUBLE, 6) AS max FROM orders""")
    for c in cats:
        name = "o_orderdate" if "o_orderdate" in c else c
        parts.append(f"""SELECT '{name}' AS column_name, (SELECT count({c}) FROM orders) AS count,
          (SELECT count(DISTINCT {c}) FROM orders) AS unique, v AS top, n AS freq,
          CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min,
          CAST(NULL AS DOUBLE) AS p25, CAST(NULL AS DOUBLE) AS p50, CAST(NULL AS DOUBLE) AS p75,
          CAST(NULL AS DOUBLE) AS max
          FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}
                ORDER BY n DESC, v ASC LIMIT 1)""")
    return "\nUNION ALL\n".join(parts)


@register("describe_all", _describe_sql())
def q_describe_all(spark, sf):
    return _round_doubles(profile.describe_all(table(spark, sf, "orders")))


@register("missing_report", with_views("lineitem_nulls") + """
SELECT * FROM (
  SELECT 'l_quantity' AS column_name, count_if(l_quantity IS NULL) AS missing,
         round(count_if(l_quantity IS NULL) * 100.0 / count(*), 2)::DOUBLE AS missing_pct, 'double' AS dtype
  FROM lineitem_nulls
  UNION ALL
  SELECT 'l_returnflag', count_if(l_returnflag IS NULL),
         round(count_if(l_returnflag IS NULL) * 100.0 / count(*), 2)::DOUBLE, 'string' FROM lineitem_nulls)
WHERE missing > 0""")
def q_missing_report(spark, sf):
    return profile.missing_report_lazy(lineitem_nulls(spark, sf))


def _ids_sql(tbl, cols, order_key):
    """cols: (name, integral, by_name)."""
    parts = []
    for c, integral, by_name in cols:
        seq = (f"""(SELECT avg(CASE WHEN abs(x - px) = 1 THEN 1.0 ELSE 0.0 END) >= 0.98 FROM (
                 SELECT {c} AS x, lag({c}) OVER (ORDER BY {order_key}) AS px FROM {tbl} WHERE {c} IS NOT NULL)
                 WHERE px IS NOT NULL)""" if integral and not by_name else "false")
        parts.append(f"""SELECT '{c}' AS column_name,
            round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio, {str(by_name).lower()} AS by_name,
            CASE WHEN count(DISTINCT {c}) / count({c}) >= 0.995 THEN coalesce({seq}, false) ELSE false END
              AS by_sequence,
            count(DISTINCT {c}) / count({c}) >= 0.995
              AND ({str(by_name).lower()} OR CASE WHEN count(DISTINCT {c}) / count({c}) >= 0.995
                                                  THEN coalesce({seq}, false) ELSE false END) AS is_id
            FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


register("detect_ids", _ids_sql("supplier", [("s_suppkey", True, False), ("s_name", False, False),
                                             ("s_nationkey", True, False)], "s_suppkey"))(
    lambda spark, sf: _round_doubles(profile.detect_id_columns(table(spark, sf, "supplier"), order_by="s_suppkey")))

register("detect_ids_events", _ids_sql("events", [("event_id", True, True), ("ts", False, False),
                                                  ("user_id", True, True), ("event_type", False, False),
                                                  ("value", False, False)], "event_id"))(
    lambda spark, sf: _round_doubles(profile.detect_id_columns(table(spark, sf, "events"), order_by="event_id")))


def q_problem_types(spark, sf):
    rows = []
    for tbl, col in (("labels", "quality"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"),
                     ("events", "event_type"), ("lineitem", "l_linenumber")):
        df = table(spark, sf, tbl)
        rows.append((tbl, col, profile.infer_problem_type(df, col), profile.target_label_type(df, col)))
    return spark.createDataFrame(rows, "table_name string, target string, problem_type string, label_type string")


def _ptype_sql(tbl, col, numeric):
    u, n = f"count(DISTINCT {col})", "count(*)"
    pt = (f"CASE WHEN {u} > greatest(15, CAST(floor(0.05 * {n}) AS BIGINT)) THEN 'regression' "
          f"ELSE 'classification' END") if numeric else "'classification'"
    lt = (f"CASE WHEN {'true' if numeric else 'false'} AND {u} > 15 THEN 'Regression' "
          f"WHEN {u} = 2 THEN 'Binary Classification' "
          f"WHEN {u} > 2 THEN 'Multi-Class Classification (' || {u} || ' classes)' "
          f"ELSE 'Regression or Single-Class' END")
    return f"SELECT '{tbl}' AS table_name, '{col}' AS target, {pt} AS problem_type, {lt} AS label_type FROM {tbl}"


register("problem_types", "\nUNION ALL\n".join(_ptype_sql(t, c, num) for t, c, num in (
    ("labels", "quality", True), ("orders", "o_totalprice", True), ("lineitem", "l_quantity", True),
    ("events", "event_type", False), ("lineitem", "l_linenumber", True))))(q_problem_types)


@register("candidate_targets", "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name FROM lineitem HAVING count(DISTINCT {c}) <= 15"
     for c, t in LINEITEM_TYPES if t in ("bigint", "int", "double")] +
    [f"SELECT '{c}' AS column_name" for c, t in LINEITEM_TYPES if t == "string"]))
def q_candidate_targets(spark, sf):
    cols = profile.candidate_targets(table(spark, sf, "lineitem"))
    return spark.createDataFrame([(c,) for c in cols], "column_name string")


@register("categorise_columns", "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) < 20 THEN 'discrete' ELSE 'continuous' END "
     f"AS role FROM lineitem" for c, t in LINEITEM_TYPES if t in ("bigint", "int", "double")] +
    [f"SELECT '{c}', 'categorical'" for c, t in LINEITEM_TYPES if t == "string"] +
    ["SELECT 'l_shipdate', 'datetime'"]))
def q_categorise(spark, sf):
    return profile.categorise_columns(table(spark, sf, "lineitem"))


@register("prep_summary", with_views("lineitem_nulls") + """,
clean AS (SELECT * FROM lineitem_nulls WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL)
SELECT (SELECT count(*) FROM lineitem_nulls) AS rows_before, 11 AS cols_before,
       (SELECT count(*) FROM clean) AS rows_after, 11 AS cols_after,
       (SELECT count(*) FROM lineitem_nulls) - (SELECT count(*) FROM clean) AS rows_removed, 0 AS cols_removed,
       (SELECT CAST(count_if(l_quantity IS NULL) + count_if(l_returnflag IS NULL) AS BIGINT) FROM lineitem_nulls)
         AS missing_before,
       CAST(0 AS BIGINT) AS missing_after,
       round((SELECT count(*) FROM clean) * 100.0 / (SELECT count(*) FROM lineitem_nulls), 2)::DOUBLE
         AS retained_pct,
       CAST(0 AS BIGINT) AS duplicates_removed""")
def q_prep_summary(spark, sf):
    raw = lineitem_nulls(spark, sf)
    return profile.prep_summary(raw, clean.drop_missing(raw, ["l_quantity", "l_returnflag"]))


# ---- C: cleaning -------------------------------------------------------------

LINEITEM_NULLS_SQL_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, {q}, l_extendedprice, l_discount, "
                           "l_tax, {r}, l_linestatus, l_shipdate")


@register("fill_median_mode", with_views("lineitem_nulls") + """,
m AS (SELECT median(l_quantity) AS med FROM lineitem_nulls),
md AS (SELECT l_returnflag AS v FROM lineitem_nulls WHERE l_returnflag IS NOT NULL
       GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag ASC LIMIT 1)
SELECT """ + LINEITEM_NULLS_SQL_COLS.format(
    q="coalesce(l_quantity, (SELECT med FROM m)) AS l_quantity",
    r="coalesce(l_returnflag, (SELECT v FROM md)) AS l_returnflag") + " FROM lineitem_nulls")
def q_fill_median_mode(spark, sf):
    df = lineitem_nulls(spark, sf)
    return clean.fit_fill(df, "median", ["l_quantity", "l_returnflag"]).transform(df)


@register("fill_mean", with_views("lineitem_nulls") + """
SELECT l_orderkey, l_linenumber,
       round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM lineitem_nulls)), 6) AS l_quantity
FROM lineitem_nulls""")
def q_fill_mean(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return _round_doubles(clean.fill_mean(df, ["l_quantity"]))


@register("fill_auto_drop", with_views("orders_mostly_null") + """
SELECT * REPLACE (""" + ORDERS_DATE_AS_TEXT + """)
FROM orders_mostly_null WHERE o_totalprice IS NOT NULL""")
def q_fill_auto_drop(spark, sf):
    _, out = clean.fit_fill_auto(orders_mostly_null(spark, sf))
    return _date_as_text(out)


@register("fill_auto", with_views("lineitem_nulls") + """,
m AS (SELECT median(l_quantity) AS med FROM lineitem_nulls),
md AS (SELECT l_returnflag AS v FROM lineitem_nulls WHERE l_returnflag IS NOT NULL
       GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag ASC LIMIT 1)
SELECT """ + LINEITEM_NULLS_SQL_COLS.format(
    q="coalesce(l_quantity, (SELECT med FROM m)) AS l_quantity",
    r="coalesce(l_returnflag, (SELECT v FROM md)) AS l_returnflag") + " FROM lineitem_nulls")
def q_fill_auto(spark, sf):
    _, out = clean.fit_fill_auto(lineitem_nulls(spark, sf))
    return out


@register("fill_log", with_views("lineitem_nulls") + """
SELECT 'l_quantity' AS column_name, 'median' AS action,
       CAST((SELECT median(l_quantity) FROM lineitem_nulls) AS VARCHAR) AS value
UNION ALL
SELECT 'l_returnflag', 'mode', (SELECT l_returnflag FROM lineitem_nulls WHERE l_returnflag IS NOT NULL
       GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag ASC LIMIT 1)""")
def q_fill_log(spark, sf):
    p, _ = clean.fit_fill_auto(lineitem_nulls(spark, sf))
    return p.log_frame(spark)


@register("count_duplicates", with_views("events_dups") + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dups)) AS n_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events_dups)) AS n_duplicates
FROM events_dups""")
def q_count_duplicates(spark, sf):
    return clean.duplicate_report(events_dups(spark, sf))


@register("dedupe", with_views("events_dups") + "SELECT DISTINCT * FROM events_dups")
def q_dedupe(spark, sf):
    return clean.drop_duplicates(events_dups(spark, sf))


@register("drop_all_null_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate FROM lineitem""")
def q_drop_all_null(spark, sf):
    return clean.drop_all_null_columns(lineitem_allnull(spark, sf))


@register("drop_missing_target", with_views("lineitem_nulls") + """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem_nulls WHERE l_returnflag IS NOT NULL""")
def q_drop_missing_target(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.drop_missing_target(df, "l_returnflag")


@register("drop_missing_rows", with_views("lineitem_nulls") + """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem_nulls WHERE l_quantity IS NOT NULL""")
def q_drop_missing(spark, sf):
    df = lineitem_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.drop_missing(df, ["l_quantity"])


@register("drop_columns", "SELECT c_custkey, c_acctbal FROM customer")
def q_drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


# ---- D: univariate -------------------------------------------------------------

def _num_stats_sql(tbl, cols):
    parts = []
    for c in cols:
        sk = f"CASE WHEN count({c}) >= 3 THEN coalesce(skewness({c}), 0) END"
        parts.append(f"""SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
          round({sk}, 6) AS skew,
          round(CASE WHEN count({c}) >= 4 THEN coalesce(kurtosis({c}), 0) END, 6) AS kurtosis,
          CASE WHEN {sk} IS NULL THEN NULL WHEN abs({sk}) < 0.5 THEN 'Normal'
               WHEN {sk} > 0 THEN 'Right-skewed' ELSE 'Left-skewed' END AS skew_label
          FROM {tbl}""")
    return "\nUNION ALL\n".join(parts)


register("numeric_stats", with_views("events_nulls") + _num_stats_sql("events_nulls", ["value", "user_id"]))(
    lambda spark, sf: _round_doubles(univariate.numeric_stats(events_nulls(spark, sf), ["value", "user_id"])))

register("numeric_stats_lineitem", _num_stats_sql(
    "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))(
    lambda spark, sf: _round_doubles(univariate.numeric_stats(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])))


def _hist_sql(tbl, col, bins_expr):
    return f"""WITH s AS (SELECT count({col}) AS n, min({col}) AS mn, max({col}) AS mx FROM {tbl}),
k AS (SELECT {bins_expr} AS nb, mn, mx, (mx - mn) / {bins_expr} AS w FROM s),
b AS (SELECT CAST(least(floor(({col} - k.mn) / k.w), k.nb - 1) AS INTEGER) AS bin, count(*) AS n
      FROM {tbl}, k WHERE {col} IS NOT NULL GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(k.mn + g.bin * k.w, 6) AS bin_lo, round(k.mn + (g.bin + 1) * k.w, 6) AS bin_hi,
       coalesce(b.n, 0) AS n, CAST(NULL AS DOUBLE) AS density
FROM k, (SELECT unnest(range(CAST((SELECT nb FROM k) AS BIGINT))) AS bin) g LEFT JOIN b ON b.bin = g.bin"""


register("histogram", _hist_sql("lineitem", "l_extendedprice",
                                "CAST(least(40, greatest(10, floor(sqrt((SELECT n FROM s))))) AS BIGINT)"))(
    lambda spark, sf: _round_doubles(univariate.histogram(table(spark, sf, "lineitem"), "l_extendedprice")))

register("histogram_fixed", _hist_sql("events", "value", "30"))(
    lambda spark, sf: _round_doubles(univariate.histogram_fixed(table(spark, sf, "events"), "value", 30)))


def _kde_sql(tbl, col, grid=200, nbins=1024, cut=3.0, by=None, top=None):
    g = f"{by}, " if by else ""
    gj = f" USING ({by})" if by else ""
    src = tbl
    if by and top:
        src = (f"(SELECT * FROM {tbl} WHERE {by} IN (SELECT {by} FROM {tbl} WHERE {by} IS NOT NULL "
               f"GROUP BY {by} ORDER BY count(*) DESC, {by} ASC LIMIT {top}))")
    return f"""WITH src AS (SELECT * FROM {src}),
s AS (SELECT {g}count({col}) AS n, stddev_samp({col}) AS sd, min({col}) AS mn, max({col}) AS mx
      FROM src {"GROUP BY " + by if by else ""}),
k AS (SELECT {g}n, sd * pow(n, -0.2) AS bw, mn, mx, (mx - mn) / {nbins} AS w FROM s WHERE n >= 2 AND sd > 0),
bins AS (SELECT {"k." + by + ", " if by else ""}least(floor((src.{col} - k.mn) / k.w), {nbins - 1}) AS b, count(*) AS c
         FROM src JOIN k {"ON src." + by + " = k." + by if by else "ON true"} WHERE src.{col} IS NOT NULL
         GROUP BY ALL),
pts AS (SELECT {g}gi, mn - {cut} * bw + gi * ((mx + {cut} * bw) - (mn - {cut} * bw)) / {grid - 1} AS x, n, bw, mn, w
        FROM k, (SELECT unnest(range({grid})) AS gi) r)
SELECT {"pts." + by + ", " if by else ""}CAST(pts.gi AS INTEGER) AS gi, round(pts.x, 6) AS x,
       round(sum(bins.c * exp(-0.5 * pow((pts.x - (pts.mn + (bins.b + 0.5) * pts.w)) / pts.bw, 2))
                 / (pts.n * pts.bw * sqrt(2 * pi()))), 6) AS density
FROM pts JOIN bins{gj if by else " ON true"}
GROUP BY ALL"""


register("kde", _kde_sql("events", "value"))(
    lambda spark, sf: _round_doubles(univariate.kde(table(spark, sf, "events"), "value")))


def _box_sql(tbl, cols, by=None):
    parts = []
    g = f"{by}, " if by else ""
    for c in cols:
        parts.append(f"""SELECT {g}'{c}' AS column_name, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
          round(q3 - q1, 6) AS iqr,
          round(min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END), 6)
            AS lower_whisker,
          round(max(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END), 6)
            AS upper_whisker,
          count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers
          FROM {tbl} t JOIN (SELECT {g}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med,
                                  quantile_cont({c}, 0.75) AS q3 FROM {tbl} {"GROUP BY " + by if by else ""}) s
            {"USING (" + by + ")" if by else "ON true"}
          WHERE {c} IS NOT NULL GROUP BY {g}q1, med, q3""")
    return "\nUNION ALL\n".join(parts)


register("box_stats", _box_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))(
    lambda spark, sf: _round_doubles(univariate.box_stats(table(spark, sf, "lineitem"),
                                                          ["l_quantity", "l_extendedprice", "l_discount"])))


@register("value_counts", """
SELECT l_returnflag AS value, count(*) AS n, round(count(*) / (SELECT count(l_returnflag) FROM lineitem), 6) AS share
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_value_counts(spark, sf):
    return _round_doubles(univariate.value_counts(table(spark, sf, "lineitem"), "l_returnflag", normalize=True))


@register("discrete_stats", "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name,
    (SELECT count(DISTINCT {c}) FROM lineitem) AS n_unique, round(CAST(v AS DOUBLE), 6) AS most_common,
    n AS most_common_n
    FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}
          ORDER BY n DESC, v ASC LIMIT 1)""" for c in ("l_discount", "l_tax", "l_linenumber")))
def q_discrete_stats(spark, sf):
    return _round_doubles(univariate.discrete_stats(table(spark, sf, "lineitem"),
                                                    ["l_discount", "l_tax", "l_linenumber"]))


@register("categorical_stats", "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name,
    (SELECT count(DISTINCT {c}) FROM part) AS n_unique, v AS most_common, n AS most_common_n,
    (SELECT count(*) FROM (SELECT count(*) AS k FROM part WHERE {c} IS NOT NULL GROUP BY {c})
      WHERE k / (SELECT count({c}) FROM part) < 0.05) AS n_rare,
    CASE WHEN (SELECT count(DISTINCT {c}) FROM part) > 10 THEN 'High' ELSE 'Low' END AS cardinality
    FROM (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}
          ORDER BY n DESC, v ASC LIMIT 1)""" for c in ("p_brand", "p_type", "p_name")))
def q_categorical_stats(spark, sf):
    return univariate.categorical_stats(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@register("top_categories", """
SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY n DESC, value ASC LIMIT 20""")
def q_top_categories(spark, sf):
    return univariate.top_categories(table(spark, sf, "part"), "p_brand", 20)


@register("target_distribution", with_views("lineitem_nulls") + """
SELECT l_returnflag AS value, count(*) AS n FROM lineitem_nulls GROUP BY l_returnflag""")
def q_target_distribution(spark, sf):
    return univariate.target_distribution(lineitem_nulls(spark, sf), "l_returnflag")


def _skew_expr(e):
    return f"CASE WHEN count({e}) >= 3 THEN coalesce(skewness({e}), 0) END"


@register("skew_before_after", "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name,
    round({_skew_expr(c)}, 6) AS skew_before,
    round({_skew_expr(f"sign({c}) * ln(1 + abs({c}))")}, 6) AS skew_after FROM {t}"""
                                                   for t, c in (("events", "value"),)))
def q_skew_before_after(spark, sf):
    return _round_doubles(univariate.skew_before_after(table(spark, sf, "events"), ["value"]))


_TARGETS = {"labels": "toxic", "embeddings": "label", "orders": "o_orderpriority", "documents": "n_chars"}


@register("detect_target", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS target, CAST({c} AS VARCHAR) AS class, count(*) AS n FROM {t} GROUP BY ALL"
    for t, c in _TARGETS.items()))
def q_detect_target(spark, sf):
    """B7 on four tables (a conventional target name wins, else the last column), with the class counts
    of each table's detected target."""
    out = None
    for t in _TARGETS:
        df = table(spark, sf, t)
        c = profile.detect_target(df)
        part = (df.groupBy(F.col(c).cast("string").alias("class")).agg(F.count("*").alias("n"))
                .select(F.lit(t).alias("table_name"), F.lit(c).alias("target"), "class", "n"))
        out = part if out is None else out.unionByName(part)
    return out
