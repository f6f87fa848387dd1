"""E: correlation, trend lines, samples, grouped statistics, crosstabs.

Correlations of k columns are k(k-1)/2 guarded expressions in ONE
aggregate (partial sums map-side); the result is a small long-form table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.distinct import at_most
from kiln.functions.exprs import pair_corr, q, seeded_hash
from kiln.operators.univariate import box_stats, kde


WIDE_CORR = 60
FEW_CORR = 6


def corr_long(df: DataFrame, cols: list[str], include_diagonal: bool = True, mirror: bool = True) -> DataFrame:
    """Pearson r per column pair, pairwise-complete; NULL when a side is constant.

    Long form ``(col_a, col_b, pos_a, pos_b, r)``. Up to FEW_CORR columns: guarded expressions
    in one aggregate; up to WIDE_CORR: products of the complete columns (``corr_long_complete``); wider:
    per-partition Gram sums (``corr_long_gram``).
    """
    if len(cols) > WIDE_CORR:
        return corr_long_gram(df, cols, include_diagonal, mirror)
    if len(cols) > FEW_CORR:
        return corr_long_complete(df, cols, include_diagonal, mirror)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    parts = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                      F.lit(i).alias("pos_a"), F.lit(j).alias("pos_b"),
                      pair_corr(F.col(q(cols[i])), F.col(q(cols[j]))).alias("r")) for i, j in pairs]
    if include_diagonal:
        # r(x, x) is 1 unless x is constant or has fewer than two values
        for i, c in enumerate(cols):
            x = F.col(q(c)).cast("double")
            parts.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(i).alias("pos_a"),
                                  F.lit(i).alias("pos_b"),
                                  F.when(F.stddev_samp(x) > 0, F.lit(1.0)).alias("r")))
    if not parts:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, pos_a int, pos_b int, r double")
    long = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    if mirror:
        mir = long.where(F.col("pos_a") != F.col("pos_b")).select(
            F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"),
            F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"), "r")
        long = long.unionByName(mir)
    return long


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """E1 wide: one row per column, one column per column (k is small)."""
    long = corr_long(df, cols)
    return long.groupBy("col_a", "pos_a").pivot("col_b", cols).agg(F.first("r")).orderBy("pos_a").drop("pos_a")


def corr_strength(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean |r| against the other columns, descending."""
    long = corr_long(df, cols, include_diagonal=False)
    return long.groupBy("col_a").agg(F.avg(F.abs("r")).alias("mean_abs_r")).withColumnRenamed(
        "col_a", "column_name").orderBy(F.desc("mean_abs_r"))


def top_corr_pairs(df: DataFrame, cols: list[str], k: int = 4) -> DataFrame:
    """Upper-triangle pairs by |r| descending (a top-k report)."""
    long = corr_long(df, cols, include_diagonal=False, mirror=False).where(F.col("r").isNotNull())
    return long.orderBy(F.desc(F.abs("r")), "pos_a", "pos_b").limit(k).select("col_a", "col_b", "r")


def corr_unstacked(df: DataFrame, cols: list[str], k: int = 10, include_diagonal: bool = True) -> DataFrame:
    """The k largest signed r of the full matrix (diagonal included by default)."""
    long = corr_long(df, cols, include_diagonal=include_diagonal).where(F.col("r").isNotNull())
    return long.orderBy(F.desc("r"), "pos_a", "pos_b").limit(k).select("col_a", "col_b", "r")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """E5: least-squares slope, intercept and R^2; NULL for a constant x."""
    xx, yy = F.col(q(x)).cast("double"), F.col(q(y)).cast("double")
    return df.agg(F.regr_count(yy, xx).alias("n"), F.regr_slope(yy, xx).alias("slope"),
                  F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"))


def sample_rows(df: DataFrame, key_cols: list[str], n: int = 1000, seed: int = 42) -> DataFrame:
    """A fixed-size, repeatable sample: the n rows with the smallest md5('<seed>|<key>').

    ``orderBy().limit()`` is a per-partition top-n followed by a merge of
    n-row lists (TakeOrderedAndProject): memory is bounded by n.
    """
    return df.withColumn("_h", seeded_hash(key_cols, seed)).orderBy("_h").limit(n).drop("_h")


def scatter_sample(df: DataFrame, x: str, y: str, key_cols: list[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """The two plotted columns of all rows, or of the E6 sample of ``n``."""
    points = df.select(*key_cols, x, y)
    return points if n is None else sample_rows(points, key_cols, n, seed)


def top_values(df: DataFrame, cat: str, k: int) -> DataFrame:
    counts = df.where(F.col(q(cat)).isNotNull()).groupBy(F.col(q(cat)).alias(cat)).agg(F.count(F.lit(1)).alias("_n"))
    return counts.orderBy(F.desc("_n"), F.asc(cat)).limit(k).select(cat)


def restrict_top(df: DataFrame, cat: str, k: int) -> DataFrame:
    """Rows whose category is among the k most frequent; the k names are found once, however often the rows are read."""
    return df.where(F.col(q(cat)).isin([r[0] for r in top_values(df, cat, k).collect()]))


def mean_by_category(df: DataFrame, cat: str, num: str, top: int = 12) -> DataFrame:
    """Mean of ``num`` per category for the ``top`` most frequent categories, descending."""
    sub = restrict_top(df, cat, top)
    return sub.groupBy(cat).agg(F.avg(F.col(q(num)).cast("double")).alias("mean_value")).orderBy(F.desc("mean_value"))


def box_by_category(df: DataFrame, cat: str, num: str, top: int = 12) -> DataFrame:
    """Quartiles and whiskers of ``num`` per (top) category."""
    return box_stats(restrict_top(df, cat, top), [num], by=cat)


def density_by_category(df: DataFrame, cat: str, num: str, top: int = 12) -> DataFrame:
    """KDE per (top) category."""
    return kde(restrict_top(df, cat, top), num, by=cat)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form, missing dropped."""
    return (df.where(F.col(q(a)).isNotNull() & F.col(q(b)).isNotNull())
            .groupBy(F.col(q(a)).alias(a), F.col(q(b)).alias(b)).agg(F.count(F.lit(1)).alias("n")))


def crosstab_wide(df: DataFrame, a: str, b: str) -> DataFrame:
    """E10 wide (pivot); use for low-cardinality ``b`` only."""
    return crosstab(df, a, b).groupBy(a).pivot(b).agg(F.first("n")).na.fill(0)


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row-normalised shares (window over the small crosstab, partitioned by ``a``)."""
    ct = crosstab(df, a, b)
    return ct.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def category_pairs(df: DataFrame, max_unique: int = 12, first: int = 4, pairs: int = 3) -> list[tuple[str, str]]:
    """Columns with 1 < n_unique <= 12 (first 4), their first 3 pairs."""
    cols = [c for c in df.columns if df.schema[c].dataType.simpleString() in ("string", "boolean")]
    u = at_most(df, dict.fromkeys(cols, max_unique))
    picked = [c for c in cols if (u[c] or 0) > 1][:first]
    out = [(picked[i], picked[j]) for i in range(len(picked)) for j in range(i + 1, len(picked))]
    return out[:pairs]


def group_mean_top(df: DataFrame, cat: str, num: str, k: int = 10) -> DataFrame:
    """Mean by category, the k largest (top-k report)."""
    g = df.groupBy(F.col(q(cat)).alias(cat)).agg(F.avg(F.col(q(num)).cast("double")).alias("mean_value"))
    return g.orderBy(F.desc("mean_value"), F.asc(cat)).limit(k)


def corr_long_complete(df: DataFrame, cols: list[str], include_diagonal: bool = True, mirror: bool = True) -> DataFrame:
    """E1 for some columns: pairs of complete, finite columns come from one sum of centred products per partition
    (k x k numbers each); only pairs with another column need the guarded expressions, which grow with the pairs."""
    import numpy as np
    import pyarrow as pa
    k = len(cols)
    x = [F.col(q(c)).cast("double") for c in cols]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(x) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    whole = [i for i in range(k) if r["n"] and r[f"n{i}"] == r["n"] and np.isfinite([r[f"lo{i}"], r[f"hi{i}"], r[f"m{i}"]]).all()]
    shift = np.array([r[f"m{i}"] for i in whole])

    def products(batches):
        total = np.zeros((len(shift), len(shift)))
        for batch in batches:
            if batch.num_rows:
                a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
                total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shift), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "p"])

    g = np.zeros((k, k))
    if whole:
        part = df.select(*[x[i].alias(f"c{i}") for i in whole]).mapInArrow(products, "i int, p array<double>")
        for row in part.groupBy("i").agg(F.array(*[F.sum(F.col("p")[j]) for j in range(len(whole))]).alias("p")).collect():
            g[whole[row["i"]], whole] = row["p"]
    pairs = [(i, j) for i in range(k) for j in range(i + (not include_diagonal), k)]
    found = {}
    for i, j in pairs:
        if i in whole and j in whole:
            flat = r[f"lo{i}"] == r[f"hi{i}"] or r[f"lo{j}"] == r[f"hi{j}"] or not g[i, i] * g[j, j] > 0
            found[i, j] = None if flat else 1.0 if i == j else float(g[i, j] / (np.sqrt(g[i, i]) * np.sqrt(g[j, j])))
    left = [p for p in pairs if p not in found]
    if left:
        # r(x, x) is 1 unless x is constant or has fewer than two values
        row = df.agg(*[(F.when(F.stddev_samp(x[i]) > 0, F.lit(1.0)) if i == j else pair_corr(x[i], x[j])).alias(str(t))
                       for t, (i, j) in enumerate(left)]).first()
        found |= {p: row[t] for t, p in enumerate(left)}
    rows = [(cols[i], cols[j], i, j, found[i, j]) for i, j in pairs]
    if mirror:
        rows += [(b, a, j, i, v) for a, b, i, j, v in rows if i != j]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, pos_a int, pos_b int, r double")


def corr_long_gram(df: DataFrame, cols: list[str], include_diagonal: bool = True, mirror: bool = True) -> DataFrame:
    """E1 for wide inputs: each partition emits pairwise-complete sums (n, Sx, Sxx, Sxy per ordered
    pair, columns shifted by their means for stability); one groupBy sums them; the k x k result
    (bounded by the column count, not the rows) is assembled on the driver."""
    import numpy as np
    import pandas as pd
    k = len(cols)
    x = [F.col(q(c)).cast("double") for c in cols]
    means = df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(x)]).first()
    shift = np.array([means[f"m{i}"] or 0.0 for i in range(k)])

    def sums(it):
        n = np.zeros((k, k))
        sx = np.zeros((k, k))
        sxx = np.zeros((k, k))
        sxy = np.zeros((k, k))
        for pdf in it:
            a = pdf.to_numpy(dtype=np.float64) - shift[None, :]
            m = (~np.isnan(a)).astype(np.float64)
            a0 = np.nan_to_num(a)
            n += m.T @ m
            sx += a0.T @ m
            sxx += (a0 * a0).T @ m
            sxy += a0.T @ a0
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pd.DataFrame({"i": ii.ravel(), "j": jj.ravel(), "n": n.ravel(), "sx": sx.ravel(),
                            "sxx": sxx.ravel(), "sxy": sxy.ravel()})

    wide = df.select(*[e.alias(f"c{i}") for i, e in enumerate(x)])
    part = wide.mapInPandas(sums, "i int, j int, n double, sx double, sxx double, sxy double")
    tot = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")]).collect()
    n = np.zeros((k, k)); sx = np.zeros((k, k)); sxx = np.zeros((k, k)); sxy = np.zeros((k, k))
    for r in tot:
        n[r["i"], r["j"]], sx[r["i"], r["j"]] = r["n"], r["sx"]
        sxx[r["i"], r["j"]], sxy[r["i"], r["j"]] = r["sxx"], r["sxy"]
    rows = []
    for i in range(k):
        for j in range(k):
            if (i == j and not include_diagonal) or (not mirror and j < i):
                continue
            nn = n[i, j]
            if nn < 2:
                r = None
            else:
                vx = nn * sxx[i, j] - sx[i, j] ** 2
                vy = nn * sxx[j, i] - sx[j, i] ** 2
                cov = nn * sxy[i, j] - sx[i, j] * sx[j, i]
                r = float(cov / np.sqrt(vx * vy)) if vx > 1e-12 * max(1.0, nn * sxx[i, j]) and \
                    vy > 1e-12 * max(1.0, nn * sxx[j, i]) else None
                if r is not None and i == j:
                    r = 1.0
            rows.append((cols[i], cols[j], i, j, r))
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, pos_a int, pos_b int, r double")
