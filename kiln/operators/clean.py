"""C: cleaning (missing values, duplicates, empty columns).

Fits are aggregates returning a few literals; transforms are ``coalesce``
projections or filters, so one fit serves train, test and streaming data.
Mode and median never use a single-task map merge: the mode comes from a
distributed ``groupBy(value)`` reduced by ``min(struct(-n, value))`` and the
median from the exact selector in ``kiln.functions.selection``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import is_numeric, is_string, q
from kiln.functions.selection import quantile_dict

# Fallback fills when a column has no value at all.
UNKNOWN_TEXT = "Unknown"
MISSING_TEXT = "missing"


def column_mode(df: DataFrame, c: str):
    """Most frequent non-null value; the smallest one among ties; None when no value."""
    counts = df.where(F.col(q(c)).isNotNull()).groupBy(F.col(q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = counts.agg(F.min(F.struct(F.negative(F.col("n")).alias("nn"), F.col("v").alias("v"))).alias("m")).first()
    return None if r["m"] is None else r["m"]["v"]


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    qd = quantile_dict(df, cols, [0.5])
    return {c: qd.get(c, {}).get(0.5) for c in cols}


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    r = df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


@dataclass
class FillParams:
    """Fitted fill values and drop subsets; ``transform`` is a pure projection + filter."""
    fills: dict = field(default_factory=dict)
    drop_subset: list = field(default_factory=list)
    log: list = field(default_factory=list)  # (column, action, value)
    drop_columns: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.drop(*[c for c in self.drop_columns if c in df.columns])
        if self.drop_subset:
            out = out.na.drop(subset=[c for c in self.drop_subset if c in out.columns])
        if self.fills:
            sel = []
            for c in out.columns:
                if c in self.fills and self.fills[c] is not None:
                    sel.append(F.coalesce(F.col(q(c)), F.lit(self.fills[c]).cast(out.schema[c].dataType)).alias(c))
                else:
                    sel.append(F.col(q(c)))
            out = out.select(*sel)
        return out

    def log_frame(self, spark) -> DataFrame:
        """Action per column."""
        return spark.createDataFrame([(c, a, None if v is None else str(v)) for c, a, v in self.log],
                                     "column_name string, action string, value string")


def fit_fill(df: DataFrame, strategy: str = "median", cols: list[str] | None = None) -> FillParams:
    """Numeric by mean/median/mode, text always by mode ('Unknown' when none)."""
    cols = list(cols or df.columns)
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    others = [c for c in cols if c not in nums]
    p = FillParams()
    if strategy == "mean":
        stats = column_means(df, nums)
    elif strategy == "median":
        stats = column_medians(df, nums)
    else:
        stats = {c: column_mode(df, c) for c in nums}
    for c in nums:
        p.fills[c] = stats[c]
        p.log.append((c, strategy, stats[c]))
    for c in others:
        m = column_mode(df, c)
        v = m if m is not None else (UNKNOWN_TEXT if is_string(df.schema[c].dataType) else None)
        p.fills[c] = v
        p.log.append((c, "mode", v))
    return p


def fill_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return fit_fill(df, "mean", cols).transform(df)


def fill_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return fit_fill(df, "median", cols).transform(df)


def fill_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return fit_fill(df, "mode", cols).transform(df)


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4."""
    return df.na.drop(subset=list(cols or df.columns))


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(q(c)).isNull()).alias(c) for c in df.columns]).first()
    return int(r["_n"]), {c: int(r[c]) for c in df.columns}


def fit_fill_auto(df: DataFrame, drop_share: float = 0.50) -> tuple[FillParams, DataFrame]:
    """Per column with missing values: share > 0.50 -> drop rows; text -> mode; numeric -> median.

    Sequential semantics: the missing count is taken once at the start, the
    row count and the fill statistic from the frame as it is at that column.
    When no column is dropped the fills are independent and fitted in one
    pass; otherwise the drops are applied in column order first.
    """
    n, miss = missing_counts(df)
    cols = [c for c in df.columns if miss[c] > 0]
    p = FillParams()
    cur = df
    cur_n = n
    pending_num: list[str] = []

    def flush():
        if not pending_num:
            return
        med = column_medians(cur, pending_num)
        for c in pending_num:
            p.fills[c] = med[c]
            p.log.append((c, "median", med[c]))
        pending_num.clear()

    for c in cols:
        share = miss[c] / cur_n if cur_n else 0.0
        if share > drop_share:
            flush()
            p.drop_subset.append(c)
            p.log.append((c, "dropped rows", None))
            cur = cur.na.drop(subset=[c])
            cur_n = cur.count()
        elif is_numeric(df.schema[c].dataType):
            pending_num.append(c)
        else:
            m = column_mode(cur, c)
            v = m if m is not None else UNKNOWN_TEXT
            p.fills[c] = v
            p.log.append((c, "mode", v))
    flush()
    return p, p.transform(df)


def count_duplicates(df: DataFrame) -> int:
    """Rows repeating an earlier full row (NULLs compare equal)."""
    r = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return int(r) - df.distinct().count()


def duplicate_report(df: DataFrame) -> DataFrame:
    """C7 lazily: total, distinct and duplicate row counts from one grouped pass."""
    cols = [F.col(q(c)) for c in df.columns]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).select(
        "n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row de-duplication (one shuffle, partial aggregation map-side)."""
    return df.dropDuplicates()


def all_null_columns(df: DataFrame) -> list[str]:
    if not df.columns:
        return []
    r = df.agg(*[F.count(F.col(q(c))).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if r[c] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """C9."""
    return df.drop(*all_null_columns(df))


def any_missing(cols: list[str]):
    if not cols:
        return F.lit(False)
    out = F.col(q(cols[0])).isNull()
    for c in cols[1:]:
        out = out | F.col(q(c)).isNull()
    return out


@dataclass
class TrainImputer:
    """Train-safe missing handling fitted on train, applied to both splits."""
    drop_columns: list = field(default_factory=list)
    drop_train_rows: bool = False
    fills: dict = field(default_factory=dict)
    low: float = 0.01
    #: Fills that apply before the test rows are judged: none where train was complete or lost its own rows.
    fill_first: bool = False
    feature_cols: list = field(default_factory=list)

    def transform_train(self, train: DataFrame) -> DataFrame:
        out = train.drop(*self.drop_columns)
        if self.drop_train_rows:
            out = out.where(~any_missing(self.feature_cols))
        return _fill(out, self.fills)

    def transform_test(self, test: DataFrame) -> DataFrame:
        out = test.drop(*[c for c in self.drop_columns if c in test.columns])
        if self.fill_first:
            out = _fill(out, self.fills)
        cols = [c for c in self.feature_cols if c in out.columns]
        r = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_missing(cols)).alias("m")).first() if cols else None
        share = (r["m"] / r["n"]) if r and r["n"] else 0.0
        if 0 < share <= self.low:
            out = out.where(~any_missing(cols))
        return _fill(out, self.fills)


def _fill(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[F.coalesce(F.col(q(c)), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in fills else F.col(q(c)) for c in df.columns])


def fit_train_imputer(train: DataFrame, test: DataFrame, features: list[str], low: float = 0.01) -> TrainImputer:
    """C10 fit: all-null columns, any-missing row share, train means / modes (one pass each)."""
    imp = TrainImputer(low=low)
    imp.drop_columns = [c for c in all_null_columns(train.select(*features))]
    feats = [c for c in features if c not in imp.drop_columns]
    imp.feature_cols = feats
    r = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(any_missing(feats)).alias("m"),
                  *[F.count_if(F.col(q(c)).isNull()).alias(f"tr_{c}") for c in feats]).first()
    share = (r["m"] / r["n"]) if r["n"] else 0.0
    imp.fill_first = share > low
    te = test.agg(*[F.count_if(F.col(q(c)).isNull()).alias(f"te_{c}") for c in feats]).first() if feats else None
    if 0 < share <= low:
        imp.drop_train_rows = True
        base = train.where(~any_missing(feats))
        need = [c for c in feats if te and te[f"te_{c}"] > 0]
    else:
        base = train
        need = [c for c in feats if r[f"tr_{c}"] > 0 or (te and te[f"te_{c}"] > 0)] if share > 0 else \
            [c for c in feats if te and te[f"te_{c}"] > 0]
    nums = [c for c in need if is_numeric(train.schema[c].dataType)]
    means = column_means(base, nums)
    for c in nums:
        imp.fills[c] = means[c] if means[c] is not None else 0.0
    for c in need:
        if c not in nums:
            m = column_mode(base, c)
            imp.fills[c] = m if m is not None else MISSING_TEXT
    return imp


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """C11."""
    return df.where(F.col(q(target)).isNotNull())


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """A projection; Catalyst prunes the columns from the scan."""
    return df.drop(*cols)
