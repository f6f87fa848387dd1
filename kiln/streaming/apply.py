"""Fitted preparation applied to Structured Streaming DataFrames.

The reference has no streaming; this is a by-product of the fit/transform
split: every fitted parameter object (fills, outlier caps, encoders,
scalers) transforms with column expressions only (or a stream-static join
for large dictionaries), so the exact preparation fitted on a batch table
runs unchanged on a ``readStream`` source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q


def apply_fitted(df: DataFrame, *params) -> DataFrame:
    """Apply fitted parameter objects in order (each has ``transform(df)``)."""
    out = df
    for p in params:
        out = p.transform(out)
    return out


def missing_counts_stream(df: DataFrame) -> DataFrame:
    """Running row and per-column missing counts of a stream (a global streaming aggregate;
    run with output mode ``complete``)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.col(q(c)).isNull()).alias(f"{c}_missing") for c in df.columns])


def windowed_profile(df: DataFrame, ts: str, value: str, window: str = "1 hour",
                     watermark: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Per event-time window (and group): count, mean and missing count of ``value``; late rows
    beyond the watermark are dropped by Spark (append mode)."""
    keys = [F.window(F.col(q(ts)), window)] + ([F.col(q(by))] if by else [])
    return (df.withWatermark(ts, watermark).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(q(value))).alias("mean_value"),
                 F.count_if(F.col(q(value)).isNull()).alias("n_missing")))
