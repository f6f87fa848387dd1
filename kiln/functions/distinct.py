"""Distinct values of many columns at once, without a shuffle of the values themselves.

A value is told apart by a key of two longs: whole numbers, booleans and dates by themselves, all other
types by 128 bits of hash (among 10^12 values of a column two share a key with a chance of about 1e-15).
So a row of the shuffle has a fixed width, whatever texts hold, and equal values meet before it.

Questions of the kind "at most t different values?" go to a sketch of all columns first. Below half its
registers the sketch only counts the registers that values hit, and t values hit t at most: an estimate
above that count proves that there are more. Only columns that are not proven wide are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType

from kiln.functions.exprs import is_bool, is_integral, q

SKETCH_ERROR = 0.02
#: Registers of a sketch with that error.
REGISTERS = 1 << math.ceil(2 * math.log2(1.106 / SKETCH_ERROR))
#: Above half the registers: standard errors between an estimate and a limit that it rules out.
MARGIN = 10
KEY = "struct<a: bigint, b: bigint>"


def value_key(c: Column, dtype: DataType) -> Column:
    """The value as a struct of two longs; null for null. The two zeros are one value, and so are all NaN."""
    kind = dtype.simpleString()
    if is_integral(dtype) or is_bool(dtype):
        pair = (c.cast("bigint"), F.lit(0).cast("bigint"))
    elif isinstance(dtype, DateType):
        pair = (F.unix_date(c).cast("bigint"), F.lit(0).cast("bigint"))
    else:
        if isinstance(dtype, (DoubleType, FloatType)):
            c = F.when(F.isnan(c), F.lit(float("nan"))).otherwise(c + F.lit(0.0))
        elif "map<" in kind or "variant" in kind:
            c = c.cast("string")
        pair = (F.xxhash64(c), F.xxhash64(F.lit(1), c))
    return F.when(c.isNotNull(), F.struct(pair[0].alias("a"), pair[1].alias("b"))).cast(KEY)


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, n_rows, n_non_null, n_missing, n_unique)`` for every column, exact but for the hash.

    No rows for an empty table.
    """
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_rows bigint, n_non_null bigint, n_missing bigint, n_unique bigint")
    places = [str(i) for i in range(len(cols))]
    wide = df.select(*[value_key(F.col(q(c)), df.schema[c].dataType).alias(i) for i, c in zip(places, cols, strict=True)])
    long = wide.unpivot([], places, "_i", "_k").select(F.col("_i").cast("int").alias("_i"), "_k.a", "_k.b")
    met = long.groupBy("_i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("a").isNotNull()
    name = F.array(*[F.lit(c) for c in cols])[F.col("_i")]
    return met.groupBy("_i").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_non_null"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_missing"), F.count("a").alias("n_unique"),
    ).select(name.alias("column_name"), "n_rows", "n_non_null", "n_missing", "n_unique")


def most_estimated(limit: int) -> float:
    """The highest estimate that a sketch can give for ``limit`` distinct values."""
    if 2 * limit <= REGISTERS:  # the sketch counts the registers hit
        return REGISTERS * math.log(REGISTERS / (REGISTERS - limit)) + 1
    return limit * (1 + MARGIN * SKETCH_ERROR)


def at_most(df: DataFrame, limits: dict[str, int]) -> dict[str, int | None]:
    """The exact number of distinct values of each column that has at most its limit, None for the others."""
    if not limits:
        return {}
    row = df.agg(*[F.approx_count_distinct(F.col(q(c)) if "map<" not in df.schema[c].dataType.simpleString() else F.col(q(c)).cast("string"),
                                           SKETCH_ERROR).alias(str(i)) for i, c in enumerate(limits)]).first()
    near = [c for i, c in enumerate(limits) if row[i] <= most_estimated(limits[c])]
    exact = {r["column_name"]: int(r["n_unique"]) for r in distinct_counts(df, near).collect()}
    return {c: exact.get(c, 0) if c in near and exact.get(c, 0) <= most else None for c, most in limits.items()}
