"""F: outlier bounds, capping and removal.

Capping is independent per column, so all bounds come from one fit and the
cap is one projection. Removal is sequential (later bounds see the rows
earlier columns left); its plan grows per column, so lineage is cut with a
reliable checkpoint every few columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import clip, q
from kiln.functions.selection import quantile_dict
from kiln.session import cut_lineage

CHECKPOINT_EVERY = 4


def iqr_bounds(df: DataFrame, cols: list[str], factor: float = 1.5,
               exact: bool = True) -> dict[str, tuple[float, float]]:
    """[Q1 - f*IQR, Q3 + f*IQR] with interpolated quartiles (``exact=False``: sketch quartiles)."""
    qd = quantile_dict(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, q3 = qd.get(c, {}).get(0.25), qd.get(c, {}).get(0.75)
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def zscore_bounds(df: DataFrame, cols: list[str], z: float = 3.0) -> dict[str, tuple[float, float]]:
    """mean +- z * sample std; columns with std 0 or missing are skipped."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = F.col(q(c)).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        if s is None or s == 0 or m is None:
            continue
        out[c] = (m - z * s, m + z * s)
    return out


def zscore_inlier_bounds(df: DataFrame, cols: list[str], z: float = 3.0) -> dict[str, tuple[float, float]]:
    """F3 (variant): population std; bounds are the min / max of the inliers (|z| <= z)."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = F.col(q(c)).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    aggs2 = []
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        x = F.col(q(c)).cast("double")
        if m is None or not s:
            inl = x.isNotNull()
        else:
            inl = F.abs((x - F.lit(m)) / F.lit(s)) <= z
        aggs2 += [F.min(F.when(inl, x)).alias(f"lo_{c}"), F.max(F.when(inl, x)).alias(f"hi_{c}")]
    r2 = df.agg(*aggs2).first()
    return {c: (r2[f"lo_{c}"], r2[f"hi_{c}"]) for c in cols if r2[f"lo_{c}"] is not None}


def fit_bounds(df: DataFrame, cols: list[str], method: str = "iqr", factor: float = 1.5,
               z: float = 3.0) -> dict[str, tuple[float, float]]:
    if method == "iqr":
        return iqr_bounds(df, cols, factor)
    if method == "zscore":
        return zscore_bounds(df, cols, z)
    if method == "zscore_inlier":
        return zscore_inlier_bounds(df, cols, z)
    raise ValueError(f"unknown outlier method {method!r}")


def outlier_mask(c: str, lo: float, hi: float):
    x = F.col(q(c))
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


@dataclass
class OutlierParams:
    bounds: dict = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    action: str = "cap"
    rows_before: int = 0
    rows_after: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """clip every column with at least one outlier (one projection, NULL kept)."""
        capped = {c: b for c, b in self.bounds.items() if self.counts.get(c, 0) > 0}
        return df.select(*[clip(F.col(q(c)), *capped[c]).alias(c) if c in capped else F.col(q(c))
                           for c in df.columns])

    def log_frame(self, spark) -> DataFrame:
        """count, action and bounds per column; rows before / after."""
        data = [(c, int(self.counts.get(c, 0)), "clipped" if self.action == "cap" else "rows removed",
                 float(lo), float(hi), int(self.rows_before), int(self.rows_after))
                for c, (lo, hi) in self.bounds.items() if self.counts.get(c, 0) > 0]
        return spark.createDataFrame(data, "column_name string, n_outliers bigint, action string, lo double, "
                                           "hi double, rows_before bigint, rows_after bigint")


def count_outliers(df: DataFrame, bounds: dict) -> dict[str, int]:
    if not bounds:
        return {}
    r = df.agg(*[F.count_if(outlier_mask(c, lo, hi)).alias(c) for c, (lo, hi) in bounds.items()]).first()
    return {c: int(r[c]) for c in bounds}


def fit_cap(df: DataFrame, cols: list[str], method: str = "iqr", factor: float = 1.5,
            z: float = 3.0) -> OutlierParams:
    """F1/F2 + F4 fit: bounds for all columns, then one counting aggregate."""
    b = fit_bounds(df, cols, method, factor, z)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(outlier_mask(c, lo, hi)).alias(c)
                                              for c, (lo, hi) in b.items()]
    r = df.agg(*aggs).first()
    p = OutlierParams(bounds=b, counts={c: int(r[c]) for c in b}, action="cap",
                      rows_before=int(r["_n"]), rows_after=int(r["_n"]))
    return p


def cap_outliers(df: DataFrame, bounds: dict) -> DataFrame:
    """F4 with given bounds."""
    return df.select(*[clip(F.col(q(c)), *bounds[c]).alias(c) if c in bounds else F.col(q(c))
                       for c in df.columns])


def remove_outliers(df: DataFrame, cols: list[str], method: str = "iqr", factor: float = 1.5,
                    z: float = 3.0, keep_null: bool = True) -> tuple[DataFrame, OutlierParams]:
    """drop outlier rows column by column; later bounds see the filtered frame.

    ``keep_null`` keeps rows whose value is missing (main application);
    ``keep_null=False`` drops them (the variant).
    """
    p = OutlierParams(action="remove")
    cur = df
    p.rows_before = int(df.count())
    for i, c in enumerate(cols):
        b = fit_bounds(cur, [c], method, factor, z)
        if c not in b:
            continue
        lo, hi = b[c]
        n_out = count_outliers(cur, {c: (lo, hi)})[c]
        p.bounds[c] = (lo, hi)
        p.counts[c] = n_out
        if n_out > 0:
            x = F.col(q(c))
            keep = (x >= F.lit(lo)) & (x <= F.lit(hi))
            cur = cur.where(F.coalesce(keep, F.lit(keep_null)))
        if (i + 1) % CHECKPOINT_EVERY == 0:
            cur = cut_lineage(cur)
    p.rows_after = int(cur.count())
    return cur, p
