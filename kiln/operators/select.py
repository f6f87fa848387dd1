"""H: feature selection (zero variance, correlation filter)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.operators.bivariate import corr_long
from kiln.operators.profile import numeric_columns


def zero_variance_columns(df: DataFrame, cols: list[str] | None = None, fill_zero: bool = False) -> list[str]:
    """H1 / H3: columns whose variance is exactly 0 on the complete rows.

    Complete = no missing value in any of the numeric columns (H1) or, with
    ``fill_zero``, every missing value counted as 0 (H3). Nothing is dropped
    when there is no complete row or when every column is constant.
    """
    cols = list(cols or numeric_columns(df))
    if not cols:
        return []
    if fill_zero:
        base = df.select(*[F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    else:
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(q(c)).isNotNull()
        base = df.where(cond)
    r = base.agg(F.count(F.lit(1)).alias("_n"),
                 *[(F.min(F.col(q(c)).cast("double")) == F.max(F.col(q(c)).cast("double"))).alias(c)
                   for c in cols]).first()
    if not r["_n"]:
        return []
    const = [c for c in cols if r[c]]
    if len(const) == len(cols):
        return []
    return const


def drop_zero_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """H1."""
    return df.drop(*zero_variance_columns(df, cols))


def variance_select_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """H3: as H1 with missing treated as 0 (the unsupervised matrix)."""
    return df.drop(*zero_variance_columns(df, cols, fill_zero=True))


def corr_filter_report(df: DataFrame, cols: list[str], thr: float = 0.95) -> DataFrame:
    """H2 decision table: for each column j, the largest |r| with an earlier column i < j
    and whether it exceeds ``thr`` (then j is dropped, even if i itself is dropped)."""
    long = corr_long(df, cols, include_diagonal=False, mirror=False)
    per = long.groupBy("col_b", "pos_b").agg(F.max(F.abs("r")).alias("max_abs_r_earlier"))
    per = per.select(F.col("col_b").alias("column_name"), F.col("pos_b").alias("position"), "max_abs_r_earlier",
                     F.coalesce(F.col("max_abs_r_earlier") > thr, F.lit(False)).alias("dropped"))
    return per


def corr_filter_columns(df: DataFrame, cols: list[str], thr: float = 0.95) -> list[str]:
    return [r["column_name"] for r in corr_filter_report(df, cols, thr).where("dropped").orderBy("position").collect()]


def corr_filter(df: DataFrame, cols: list[str], thr: float = 0.95) -> DataFrame:
    """H2: drop every column j with |r(i, j)| > thr for some earlier i (missing r never triggers)."""
    return df.drop(*corr_filter_columns(df, cols, thr))
