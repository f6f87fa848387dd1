"""Row order without a single-partition window.

Spark has no row index, and ``Window.orderBy`` without ``partitionBy``
sorts the whole table in one task. Here the rows are range-partitioned by
the order key (any type; further key columns split ties), the window runs
per range, and the few cross-range facts (first/last row, row counts) are
fixed with a small table of one row per range. Range bounds come from a
sample, so the dealt rows are checkpointed once and read from there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.session import cut_lineage

ROWS_PER_BUCKET = 2_000_000


def _bucketed(df: DataFrame, *order_cols: str) -> DataFrame:
    nb = max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    if nb == 1:
        return df.withColumn("_bk", F.lit(0))
    return cut_lineage(df.repartitionByRange(nb, *order_cols).withColumn("_bk", F.spark_partition_id()))


def row_index(df: DataFrame, order_cols: list[str], name: str = "_idx") -> DataFrame:
    """0-based position in ``order_cols`` order (ties broken by the remaining columns given)."""
    b = _bucketed(df, *order_cols)
    counts = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    wcum = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of ROWS_PER_BUCKET rows
    offsets = counts.select("_bk", F.coalesce(F.sum("_n").over(wcum), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_bk").orderBy(*order_cols)
    out = b.join(F.broadcast(offsets), "_bk").withColumn(name, F.col("_off") + F.row_number().over(w) - 1)
    return out.drop("_bk", "_off")


def lag_pairs(df: DataFrame, order_col: str, cols: list[str]) -> DataFrame:
    """Each row with the previous row's ``cols`` (``prev_<c>``) in ``order_col`` order."""
    b = _bucketed(df.select(order_col, *cols), order_col)
    w = Window.partitionBy("_bk").orderBy(order_col)
    inner = b.select("_bk", order_col, *cols,
                     *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols],
                     F.row_number().over(w).alias("_rn"))
    # last row of each bucket, attached to the first row of the next bucket
    last = (b.groupBy("_bk")
            .agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_last")))
    wn = Window.orderBy("_bk")
    nxt = last.select(F.lead("_bk").over(wn).alias("_bk"), "_last").where(F.col("_bk").isNotNull())
    joined = inner.join(F.broadcast(nxt), "_bk", "left")
    fixed = [F.when(F.col("_rn") == 1, F.col(f"_last.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}")
             for c in cols]
    return joined.select(order_col, *cols, *fixed)


def running_sum(df: DataFrame, order_col: str, value_col: str, out: str, inclusive: bool = True) -> DataFrame:
    """Cumulative sum of ``value_col`` in ``order_col`` order (unique order values assumed)."""
    b = _bucketed(df, order_col)
    totals = b.groupBy("_bk").agg(F.sum(value_col).alias("_t"))
    wcum = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of ROWS_PER_BUCKET rows
    offsets = totals.select("_bk", F.coalesce(F.sum("_t").over(wcum), F.lit(0)).alias("_off"))
    end = 0 if inclusive else -1
    w = Window.partitionBy("_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    res = b.join(F.broadcast(offsets), "_bk").withColumn(
        out, F.col("_off") + F.coalesce(F.sum(value_col).over(w), F.lit(0)))
    return res.drop("_bk", "_off")


def _segmented(df: DataFrame, segment: str, order_cols: list[str]) -> DataFrame:
    """Rows range-partitioned by (segment, order); the segment sits in a struct, so that missing is a segment too."""
    return _bucketed(df.withColumn("_seg", F.struct(F.col(q(segment)).alias("s"))), "_seg", *order_cols)


def _carry(b: DataFrame, total: Column) -> DataFrame:
    """``b`` with ``_off``: what earlier ranges hold of the row's segment."""
    w = Window.partitionBy("_seg").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    before = (b.groupBy("_bk", "_seg").agg(total.alias("_t"))
              .select("_bk", "_seg", F.sum("_t").over(w).alias("_off")).where(F.col("_off").isNotNull()))
    # a segment that began in an earlier range is the first of its range: at most one row per range
    return (b.join(F.broadcast(before), ["_bk", "_seg"], "left")
            .withColumn("_off", F.coalesce("_off", F.lit(0))))


def segment_index(df: DataFrame, segment: str, order_cols: list[str], name: str = "_idx") -> DataFrame:
    """0-based position within each value of ``segment`` (missing is one value). A hot segment spans
    several ranges, and a range holds many small segments."""
    b = _carry(_segmented(df, segment, order_cols), F.count(F.lit(1)))
    w = Window.partitionBy("_bk", "_seg").orderBy(*order_cols)
    return b.withColumn(name, F.col("_off") + F.row_number().over(w) - 1).drop("_bk", "_seg", "_off")


def segment_running_sum(df: DataFrame, segment: str, order_col: str, value_col: str, out: str,
                        inclusive: bool = True) -> DataFrame:
    """Cumulative sum of ``value_col`` within each ``segment`` (order values unique in it)."""
    b = _carry(_segmented(df, segment, [order_col]), F.sum(value_col))
    end = 0 if inclusive else -1
    w = Window.partitionBy("_bk", "_seg").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    return b.withColumn(out, F.col("_off") + F.coalesce(F.sum(value_col).over(w), F.lit(0))).drop("_bk", "_seg", "_off")
