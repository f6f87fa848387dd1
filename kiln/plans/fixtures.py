"""Derived dirty views of the driver tables.

The driver tables have no NULL and no full-row duplicate, so the cleaning
operators get defects that Spark and DuckDB derive identically from the
whole tables (every row is read; only the defect placement uses a key rule).
Each view exists twice: a Spark builder and the SQL text used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_nulls(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = []
    for c in li.columns:
        if c == "l_quantity":
            cols.append(F.when(F.col("l_orderkey") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c))
        elif c == "l_returnflag":
            cols.append(F.when(F.col("l_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return li.select(*cols)


def events_nulls(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(*[F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                       if c == "value" else F.col(c) for c in ev.columns])


def orders_mostly_null(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(*[F.when(F.col("o_orderkey") % 5 != 0, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                      if c == "o_totalprice" else F.col(c) for c in o.columns])


def events_dups(spark, sf):
    ev = table(spark, sf, "events")
    return ev.unionByName(ev.where(F.col("event_id") % 50 == 0))


def customer_bool_text(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("c_flag", F.when(F.col("c_acctbal") > 0, F.lit(" Yes")).otherwise(F.lit("no")))


def supplier_const(spark, sf):
    return table(spark, sf, "supplier").withColumn("k", F.lit(1.0))


def lineitem_twin(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_price2", F.col("l_extendedprice") * 2 + 1)


def lineitem_allnull(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_note", F.lit(None).cast("string"))


# SQL twins (DuckDB), used inside WITH clauses of the oracle queries.
SQL = {
    "lineitem_nulls": """lineitem_nulls AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               l_extendedprice, l_discount, l_tax,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_linestatus, l_shipdate FROM lineitem)""",
    "events_nulls": """events_nulls AS (
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)""",
    "orders_mostly_null": """orders_mostly_null AS (
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority FROM orders)""",
    "events_dups": """events_dups AS (
        SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)""",
    "customer_bool_text": """customer_bool_text AS (
        SELECT *, CASE WHEN c_acctbal > 0 THEN ' Yes' ELSE 'no' END AS c_flag FROM customer)""",
    "supplier_const": """supplier_const AS (SELECT *, CAST(1.0 AS DOUBLE) AS k FROM supplier)""",
    "lineitem_twin": """lineitem_twin AS (SELECT *, l_extendedprice * 2 + 1 AS l_price2 FROM lineitem)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
