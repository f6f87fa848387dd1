"""J: scaler choice and scaling (fit on train, lazy projection on any split)."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import finite, q, skew_sample

STANDARD = "StandardScaler"
MINMAX = "MinMaxScaler"
SKEW_LIMIT = 1.0


def choose_scaler(df: DataFrame, cols: list[str]) -> str:
    """Min-max when the median |skew| over columns exceeds 1.0, else standard."""
    if not cols:
        return STANDARD
    r = df.agg(*[skew_sample(finite(F.col(q(c)))).alias(c) for c in cols]).first()
    vals = [abs(r[c]) for c in cols if r[c] is not None]
    if not vals:
        return STANDARD
    return MINMAX if median(vals) > SKEW_LIMIT else STANDARD


@dataclass
class ScalerParams:
    kind: str = STANDARD
    a: dict = field(default_factory=dict)   # mean or min
    b: dict = field(default_factory=dict)   # population std or range

    def expr(self, c: str):
        x = F.col(q(c)).cast("double")
        d = self.b.get(c)
        if not d:
            # constant column -> 0 (missing stays missing)
            return F.when(x.isNotNull(), F.lit(0.0))
        return (x - F.lit(self.a[c])) / F.lit(d)

    def sql(self, c: str) -> str:
        """``expr`` as SQL text."""
        x, d = f"CAST({q(c)} AS DOUBLE)", self.b.get(c)
        return f"(({x}) - ({self.a[c]!r}D)) / ({d!r}D)" if d else f"CASE WHEN {x} IS NOT NULL THEN 0.0D END"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expr(c).alias(c) if c in self.a else F.col(q(c)) for c in df.columns])


def fit_scaler(df: DataFrame, cols: list[str], kind: str = STANDARD) -> ScalerParams:
    """J2 / J3 fit in one aggregate: mean + population std, or min + range."""
    p = ScalerParams(kind=kind)
    if not cols:
        return p
    aggs = []
    for c in cols:
        x = F.col(q(c)).cast("double")
        if kind == STANDARD:
            aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_pop(x).alias(f"b_{c}")]
        else:
            aggs += [F.min(x).alias(f"a_{c}"), (F.max(x) - F.min(x)).alias(f"b_{c}")]
    r = df.agg(*aggs).first()
    for c in cols:
        p.a[c], p.b[c] = r[f"a_{c}"], r[f"b_{c}"]
    return p


def standard_scale(train: DataFrame, cols: list[str], *others: DataFrame):
    """(x - mean) / population std, fitted on ``train``."""
    p = fit_scaler(train, cols, STANDARD)
    return tuple(p.transform(d) for d in (train, *others))


def minmax_scale(train: DataFrame, cols: list[str], *others: DataFrame):
    """(x - min) / (max - min), fitted on ``train``; constant -> 0."""
    p = fit_scaler(train, cols, MINMAX)
    return tuple(p.transform(d) for d in (train, *others))


def build_pipeline(estimator, feature_cols: list[str], scaler: str = STANDARD, use_scaler: bool = True,
                   label_col: str = "label", resample: bool = False, seed: int = 42):
    """(scaler) -> (oversampling, of training rows only) -> estimator, as one estimator.

    The scaler is that of J2 / J3 (population deviation, constant columns to 0), held as a SQL stage
    that saves with the fitted pipeline.
    """
    from kiln.operators.stages import ResampledEstimator
    return ResampledEstimator(estimator, feature_cols, scaler, use_scaler, label_col, resample, seed)
