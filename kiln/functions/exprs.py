"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q(name: str) -> str:
    """Back-quote a column name for use inside SQL expression strings."""
    return "`" + name.replace("`", "``") + "`"


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_temporal(dt) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def is_string(dt) -> bool:
    return isinstance(dt, T.StringType)


def is_bool(dt) -> bool:
    return isinstance(dt, T.BooleanType)


def finite(c, inf_to_null: bool = True) -> Column:
    """A2: numeric view of a column; unparseable text, NaN and +-inf become NULL."""
    x = col_(c).try_cast("double")
    bad = F.isnan(x)
    if inf_to_null:
        bad = bad | x.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(None).cast("double")).otherwise(x)


def as_text(c) -> Column:
    """Any value as text, missing stays missing."""
    return col_(c).cast("string")


def signed_log(c) -> Column:
    """sign(x) * log1p(|x|)."""
    x = col_(c).cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def clip(c, lo, hi) -> Column:
    """clip keeping NULL (least/greatest would skip NULL)."""
    x = col_(c)
    out = x
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    return out


def skew_sample(c) -> Column:
    """Bias-corrected sample skewness (pandas/DuckDB), NULL for n < 3, 0 for a constant."""
    x = col_(c)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(adj, F.lit(0.0)))


def kurt_sample(c) -> Column:
    """Bias-corrected excess kurtosis (pandas/DuckDB), NULL for n < 4, 0 for a constant."""
    x = col_(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(adj, F.lit(0.0)))


def pair_corr(a, b) -> Column:
    """Pearson r on pairwise-complete rows; NULL for a constant side (no ANSI error)."""
    x, y = col_(a).cast("double"), col_(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def skew_label(skew: Column) -> Column:
    """Normal / Right-skewed / Left-skewed."""
    return (F.when(skew.isNull(), F.lit(None).cast("string"))
            .when(F.abs(skew) < 0.5, F.lit("Normal"))
            .when(skew > 0, F.lit("Right-skewed"))
            .otherwise(F.lit("Left-skewed")))


def seeded_hash(key_cols, seed: int = 42) -> Column:
    """Repeatable pseudo-random order key: md5('<seed>|<key>') (same text in DuckDB)."""
    parts = [F.lit(str(seed))]
    for k in key_cols:
        parts += [F.lit("|"), col_(k).cast("string")]
    return F.md5(F.concat(*parts))


def hash_unit(key_cols, seed: int = 42) -> Column:
    """A number in [0, 1) derived from the seeded md5 (first 13 hex digits)."""
    h = seeded_hash(key_cols, seed)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def hist_bins(n: int) -> int:
    """Number of bins used for a column of n values."""
    return min(40, max(10, int(math.sqrt(n)))) if n > 0 else 10


def rround(c, digits: int = 6) -> Column:
    return F.round(col_(c).cast("double"), digits)
