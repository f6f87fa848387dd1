"""Distinct counts on typed keys, and the sketch that settles most questions first."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kiln.functions import distinct
from kiln.operators import profile


def test_counts_of_every_type(spark):
    rows = [(1, 1.5, "a", True, dt.date(2020, 1, 1), dt.datetime(2020, 1, 1), Decimal("1.10"), [1, 2], {"k": 1}),
            (2, float("nan"), "", False, dt.date(2020, 1, 2), dt.datetime(2020, 1, 1), Decimal("1.1"), [1, 2], {"k": 2}),
            (2, float("nan"), "a ", None, None, dt.datetime(1969, 1, 1), None, [], {"k": 1}),
            (None, 0.0, None, None, None, None, None, None, None),
            (-5, -0.0, "A", True, None, None, Decimal("0"), [1], None)]
    df = spark.createDataFrame(rows, "i int, d double, s string, b boolean, day date, at timestamp, m decimal(9,2), "
                                     "l array<int>, `odd.name` map<string,int>")
    got = {r["column_name"]: tuple(r)[1:] for r in distinct.distinct_counts(df).collect()}
    assert got == {"i": (5, 4, 1, 3), "d": (5, 5, 0, 3), "s": (5, 4, 1, 4), "b": (5, 3, 2, 2), "day": (5, 2, 3, 2), "at": (5, 3, 2, 2),
                   "m": (5, 3, 2, 2), "l": (5, 4, 1, 3), "odd.name": (5, 3, 2, 2)}


def test_empty_table_and_no_columns(spark):
    df = spark.createDataFrame([], "x int, y string")
    assert distinct.distinct_counts(df).collect() == [] and distinct.distinct_counts(df, []).collect() == []
    assert distinct.at_most(df, {"x": 3, "y": 0}) == {"x": 0, "y": 0} and distinct.at_most(df, {}) == {}


@pytest.mark.parametrize("limit", [0, 1, 9, 15, 20, 500, 2048, 2049, 9000])
def test_limits_are_met_exactly(spark, limit):
    df = spark.range(3 * limit + 9).select(*[F.concat(F.lit("v"), F.pmod("id", F.lit(max(1, n)))).alias(f"n{n}") if n > 0
                                             else F.lit(None).cast("string").alias(f"n{n}") for n in (limit, limit + 1, 3 * limit + 8)])
    got = distinct.at_most(df, dict.fromkeys(df.columns, limit))
    assert got == {f"n{limit}": limit, f"n{limit + 1}": None, f"n{3 * limit + 8}": None}


def test_wide_columns_are_settled_by_the_sketch(spark, monkeypatch):
    asked = []
    count = distinct.distinct_counts
    monkeypatch.setattr(distinct, "distinct_counts", lambda df, cols=None: asked.append(cols) or count(df, cols))
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("few"), F.rand(1).alias("x"))
    assert profile.candidate_targets(df) == ["few"] and asked == [["few"]]


def test_no_text_is_shuffled(spark):
    df = spark.createDataFrame([("some text", 1.0)], "s string, x double")
    plan = distinct.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(_i" in line for line in exchanges)
    grouped = [line for line in plan.splitlines() if "HashAggregate" in line]
    assert not any("keys=[" in line and "s#" in line.split("keys=[")[1].split("]")[0] for line in grouped)
