"""D: univariate statistics and chart data (histogram, KDE, box, counts).

Everything a chart needs is returned as a small DataFrame whose size is
bounded by the number of bins / grid points / categories asked for, never
by the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import finite, hist_bins, kurt_sample, q, signed_log, skew_label, skew_sample
from kiln.functions.selection import exact_quantiles

RARE_SHARE = 0.05
HIGH_CARDINALITY = 10
KDE_BINS = 1024
KDE_GRID = 200
KDE_CUT = 3.0


def numeric_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, std, corrected skew and kurtosis, skew label; one aggregate for all columns."""
    parts = []
    for c in cols:
        x = finite(F.col(q(c)))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.avg(x).alias("mean"),
                              F.stddev_samp(x).alias("std"), skew_sample(x).alias("skew"),
                              kurt_sample(x).alias("kurtosis")))
    agg = df.agg(F.array(*parts).alias("a"))
    out = agg.select(F.explode("a").alias("s")).select("s.*")
    return out.withColumn("skew_label", skew_label(F.col("skew")))


def _range_stats(df: DataFrame, col: str):
    x = finite(F.col(q(col)))
    return df.agg(F.count(F.col(q(col))).alias("n"), F.count(x).alias("nf"),
                  F.min(x).alias("mn"), F.max(x).alias("mx")).first()


def histogram(df: DataFrame, col: str, bins: int | None = None, density: bool = False) -> DataFrame:
    """Equal-width bins over [min, max]; the last edge is inclusive; empty bins kept.

    ``bins`` defaults to min(40, max(10, int(sqrt(n)))) with n counted
    before non-finite values are dropped. A constant column is one spike.
    """
    spark = df.sparkSession
    st = _range_stats(df, col)
    schema = "bin int, bin_lo double, bin_hi double, n bigint, density double"
    if st["nf"] == 0:
        return spark.createDataFrame([], schema)
    nb = bins or hist_bins(int(st["n"]))
    mn, mx = float(st["mn"]), float(st["mx"])
    x = finite(F.col(q(col)))
    if mn == mx:
        return spark.createDataFrame([(0, mn, mx, int(st["nf"]), None)], schema)
    w = (mx - mn) / nb
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(w)).cast("int"), F.lit(nb - 1))
    counts = df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))
    # bins is <= a few hundred: the grid side of this join has a fixed size
    grid = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left").fillna(0, subset=["n"])
    total = float(st["nf"])
    dens = (F.col("n") / F.lit(total * w)) if density else F.lit(None).cast("double")
    return out.select("bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("bin_lo"),
                      (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("bin_hi"),
                      F.col("n").cast("long").alias("n"), dens.alias("density"))


def histogram_fixed(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """D3."""
    return histogram(df, col, bins=bins)


def kde(df: DataFrame, col: str, grid: int = KDE_GRID, by: str | None = None) -> DataFrame:
    """Gaussian density (Scott bandwidth) evaluated from a fine histogram.

    The data are first reduced to KDE_BINS counts (per group); the grid is
    evaluated on those counts, so cost does not depend on the row count.
    """
    x = finite(F.col(q(col)))
    keys = [by] if by else []
    st = df.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"),
                               F.min(x).alias("mn"), F.max(x).alias("mx"))
    st = st.where((F.col("n") >= 2) & (F.col("sd") > 0))
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.withColumn("w", (F.col("mx") - F.col("mn")) / KDE_BINS)
    data = df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull())
    if keys:
        j = data.join(st, keys, "inner")  # AQE broadcasts the group table if it turns out small
    else:
        r = st.first()
        if r is None:
            return df.sparkSession.createDataFrame([], "gi int, x double, density double")
        j = data.select("_x", *[F.lit(r[c]).alias(c) for c in ("n", "sd", "mn", "mx", "bw", "w")])
    j = j.withColumn("_b", F.least(F.floor((F.col("_x") - F.col("mn")) / F.col("w")).cast("int"),
                                   F.lit(KDE_BINS - 1)))
    binned = j.groupBy(*keys, "_b", "n", "bw", "mn", "mx", "w").agg(F.count(F.lit(1)).alias("c"))
    centre = F.col("mn") + (F.col("_b") + 0.5) * F.col("w")
    lo = F.col("mn") - KDE_CUT * F.col("bw")
    hi = F.col("mx") + KDE_CUT * F.col("bw")
    g = binned.select(*keys, "n", "bw", "c", centre.alias("ctr"),
                      F.posexplode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi", "_g"), lo.alias("lo"),
                      hi.alias("hi"))
    xg = F.col("lo") + F.col("gi") * (F.col("hi") - F.col("lo")) / (grid - 1)
    u = (xg - F.col("ctr")) / F.col("bw")
    dens = F.col("c") * F.exp(-0.5 * u * u) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return (g.select(*keys, "gi", xg.alias("x"), dens.alias("d"))
            .groupBy(*keys, "gi", "x").agg(F.sum("d").alias("density")))


def box_stats(df: DataFrame, cols: list[str], by: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the most extreme data inside the fences, outlier count."""
    keys = [by] if by else []
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], by=keys)
    wide = qs.groupBy(*keys, "column_name").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(a)
          for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1"))
    wide = wide.withColumn("lo_fence", F.col("q1") - whisker * F.col("iqr")) \
               .withColumn("hi_fence", F.col("q3") + whisker * F.col("iqr"))
    if not keys:
        return _box_global(df, wide)
    long = df.select(*keys, *[F.col(q(c)).cast("double").alias(c) for c in cols]) \
        .unpivot(keys, cols, "column_name", "_x").where(F.col("_x").isNotNull())
    # AQE broadcasts the fences if they turn out small
    j = long.join(wide.select(*keys, "column_name", "lo_fence", "hi_fence"), keys + ["column_name"])
    inside = (F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence"))
    wh = j.groupBy(*keys, "column_name").agg(
        F.min(F.when(inside, F.col("_x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_x"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"))
    return wide.join(wh, keys + ["column_name"]).select(
        *keys, "column_name", "q1", "median", "q3", "iqr", "lower_whisker", "upper_whisker", "n_outliers")


def _box_global(df: DataFrame, wide: DataFrame) -> DataFrame:
    """Whiskers of ungrouped columns: the fences are literals, so one aggregate, no join."""
    fences = wide.collect()  # one row per column
    aggs = []
    for i, r in enumerate(fences):
        x = F.col(q(r["column_name"])).cast("double")
        inside = (x >= F.lit(r["lo_fence"])) & (x <= F.lit(r["hi_fence"]))
        aggs += [F.min(F.when(inside, x)).alias(f"lw{i}"), F.max(F.when(inside, x)).alias(f"uw{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"no{i}")]
    wh = df.agg(*aggs).first() if aggs else None
    rows = [(r["column_name"], r["q1"], r["median"], r["q3"], r["iqr"], wh[f"lw{i}"], wh[f"uw{i}"], wh[f"no{i}"])
            for i, r in enumerate(fences)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, median double, q3 double, iqr double, lower_whisker double, "
              "upper_whisker double, n_outliers long")


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Text value, count, share of non-missing; ordered by count desc, value asc."""
    v = F.col(q(col)).cast("string")
    total = df.agg(F.count(v).alias("t")).first()["t"] or 0
    counts = df.select(v.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("share", F.col("n") / F.lit(float(total)) if total else F.lit(None).cast("double"))
    if not normalize:
        out = out.select("value", "n", "share")
    return out.orderBy(F.desc("n"), F.asc("value"))


def _freq_long(df: DataFrame, cols: list[str]) -> DataFrame:
    wide = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols])
    return (wide.unpivot([], cols, "column_name", "value").where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def categorical_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """n_unique, most common (smallest among ties), its count, rare categories (< 5 %), cardinality."""
    ft = _freq_long(df, cols)
    g = ft.groupBy("column_name").agg(
        F.count("value").alias("n_unique"),
        F.sum("n").alias("_tot"),
        F.min(F.struct(F.negative(F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("_m"))
    rare = ft.join(g.select("column_name", "_tot"), "column_name").groupBy("column_name").agg(
        F.count_if(F.col("n") / F.col("_tot") < RARE_SHARE).alias("n_rare"))
    out = g.join(rare, "column_name")
    return out.select("column_name", "n_unique", F.col("_m.v").alias("most_common"),
                      F.negative(F.col("_m.nn")).alias("most_common_n"), "n_rare",
                      F.when(F.col("n_unique") > HIGH_CARDINALITY, "High").otherwise("Low").alias("cardinality"))


def discrete_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric discrete columns: n_unique, most common value (smallest among ties), its count."""
    wide = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols])
    ft = (wide.unpivot([], cols, "column_name", "value").where(F.col("value").isNotNull())
          .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    g = ft.groupBy("column_name").agg(
        F.count("value").alias("n_unique"),
        F.min(F.struct(F.negative(F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("_m"))
    return g.select("column_name", "n_unique", F.col("_m.v").alias("most_common"),
                    F.negative(F.col("_m.nn")).alias("most_common_n"))


def top_categories(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values (a top-k report: the limit is the feature)."""
    v = F.col(q(col)).cast("string")
    counts = df.select(v.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Counts per target value, the missing group kept."""
    return df.groupBy(F.col(q(target)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def skew_before_after(df: DataFrame, cols: list[str]) -> DataFrame:
    """Corrected skew of each column and of its signed log, one aggregate."""
    parts = [F.struct(F.lit(c).alias("column_name"), skew_sample(finite(F.col(q(c)))).alias("skew_before"),
                      skew_sample(signed_log(finite(F.col(q(c))))).alias("skew_after")) for c in cols]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
