"""O: operators stated in the specification (date parts, binning, interactions, leakage,
VIF, type repair, anomaly flags, importance-based selection)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import is_numeric, q
from kiln.functions.selection import quantile_dict
from kiln.operators.bivariate import corr_long


def date_parts(df: DataFrame, col: str) -> DataFrame:
    """O1: year, month and weekday (0 = Monday) of a date/timestamp column appended."""
    x = F.col(q(col))
    return df.select("*", F.year(x).alias(f"{col}_year"), F.month(x).alias(f"{col}_month"),
                     ((F.dayofweek(x) + 5) % 7).alias(f"{col}_weekday"))


def equal_width_bins(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """O2: bucket 0..bins-1 over [min, max] (last edge inclusive)."""
    r = df.agg(F.min(F.col(q(col))).alias("mn"), F.max(F.col(q(col))).alias("mx")).first()
    mn, mx = r["mn"], r["mx"]
    if mn is None:
        return df.withColumn(f"{col}_bin", F.lit(None).cast("int"))
    if mn == mx:
        return df.withColumn(f"{col}_bin", F.when(F.col(q(col)).isNotNull(), F.lit(0)))
    w = (mx - mn) / bins
    b = F.least(F.floor((F.col(q(col)) - F.lit(mn)) / F.lit(w)).cast("int"), F.lit(bins - 1))
    return df.withColumn(f"{col}_bin", b)


def quantile_bins(df: DataFrame, col: str, bins: int = 4) -> DataFrame:
    """O2: quantile bins from exact interior quantiles: bin = number of cut points <= x."""
    probs = [i / bins for i in range(1, bins)]
    cuts = quantile_dict(df, [col], probs)[col]
    x = F.col(q(col))
    b = F.lit(0)
    for p in probs:
        b = b + F.when(x >= F.lit(cuts[round(p, 12)]), 1).otherwise(0)
    return df.withColumn(f"{col}_qbin", F.when(x.isNotNull(), b))


def interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """O3: pairwise products ``a_x_b``."""
    return df.select("*", *[(F.col(q(a)).cast("double") * F.col(q(b)).cast("double")).alias(f"{a}_x_{b}")
                            for a, b in pairs])


def leakage_check(df: DataFrame, target: str, features: list[str], threshold: float = 0.98) -> DataFrame:
    """Per feature, |r| with a numeric target and the share of rows whose target equals the
    most common target of their feature value (1.0 = the feature determines the target)."""
    spark = df.sparkSession
    rows = []
    nums = [c for c in features if is_numeric(df.schema[c].dataType)]
    rmap = {}
    if is_numeric(df.schema[target].dataType) and nums:
        long = corr_long(df, [target] + nums, include_diagonal=False, mirror=False)
        rmap = {r["col_b"]: r["r"] for r in long.where(F.col("col_a") == target).collect()}
    n = df.where(F.col(q(target)).isNotNull()).count()
    for c in features:
        g = (df.where(F.col(q(target)).isNotNull())
             .groupBy(F.col(q(c)).alias("_v"), F.col(q(target)).alias("_t")).agg(F.count(F.lit(1)).alias("_n")))
        best = g.groupBy("_v").agg(F.max("_n").alias("_m")).agg(F.sum("_m").alias("s")).first()["s"] or 0
        share = best / n if n else None
        r = rmap.get(c)
        rows.append((c, None if r is None else abs(float(r)), share,
                     bool((r is not None and abs(r) >= threshold) or (share is not None and share >= threshold))))
    return spark.createDataFrame(rows, "column_name string, abs_r double, determinism double, suspect boolean")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factors = diagonal of the inverse correlation matrix (k x k on the driver)."""
    k = len(cols)
    m = np.eye(k)
    for r in corr_long(df, cols, include_diagonal=False, mirror=False).collect():
        v = r["r"] if r["r"] is not None else 0.0
        m[r["pos_a"], r["pos_b"]] = m[r["pos_b"], r["pos_a"]] = v
    inv = np.linalg.pinv(m)
    return df.sparkSession.createDataFrame([(c, float(inv[i, i])) for i, c in enumerate(cols)],
                                           "column_name string, vif double")


def type_repair_report(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """For text columns, the share of non-null values that parse as number / timestamp and
    the suggested type (share >= threshold)."""
    cols = [c for c in df.columns if df.schema[c].dataType.simpleString() == "string"]
    aggs = []
    for c in cols:
        x = F.col(q(c))
        aggs += [F.count(x).alias(f"n_{c}"), F.count(x.try_cast("double")).alias(f"d_{c}"),
                 F.count(F.try_to_timestamp(x)).alias(f"t_{c}")]
    r = df.agg(*aggs).first() if aggs else None
    rows = []
    for c in cols:
        n = r[f"n_{c}"]
        dshare = r[f"d_{c}"] / n if n else None
        tshare = r[f"t_{c}"] / n if n else None
        sug = "double" if dshare is not None and dshare >= threshold else (
            "timestamp" if tshare is not None and tshare >= threshold else "string")
        rows.append((c, dshare, tshare, sug))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, numeric_share double, timestamp_share double, suggested string")


def anomaly_flags(df: DataFrame, cols: list[str], z: float = 3.0) -> DataFrame:
    """Row score = largest |z| over the columns (sample std); anomaly when > z."""
    r = df.agg(*[F.avg(F.col(q(c))).alias(f"m_{c}") for c in cols],
               *[F.stddev_samp(F.col(q(c))).alias(f"s_{c}") for c in cols]).first()
    zs = [F.abs((F.col(q(c)) - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"])) for c in cols if r[f"s_{c}"]]
    score = F.greatest(*zs) if len(zs) > 1 else (zs[0] if zs else F.lit(None).cast("double"))
    return df.withColumn("anomaly_score", score).withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") > z,
                                                                                     F.lit(False)))


def select_by_importance(importances: list[tuple[str, float]], threshold: str | float = "mean") -> list[str]:
    """Keep features whose importance is >= the threshold (default: the mean importance)."""
    if not importances:
        return []
    thr = float(np.mean([v for _, v in importances])) if threshold == "mean" else float(threshold)
    return [f for f, v in importances if v >= thr]
