"""Steps of the preparation flow whose cost grew faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions import selection
from kiln.operators import bivariate
from kiln.plans.prepare import PrepConfig, prepare


def test_correlations_of_complete_and_other_columns(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(200, 9)) * [1, 2, 3, 1e-3, 1, 1, 1, 1, 1] + [0, 1e6, 0, 0, 0, 0, 0, 0, 0]
    a[:, 4], a[:, 5] = 0.1, a[:, 0] * 2 + 1
    rows = [tuple(None if j == 6 and i % 5 == 0 else float("nan") if j == 7 and i == 3 else float(x) for j, x in enumerate(r)) for i, r in enumerate(a)]
    cols = [f"c{j}" for j in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    old = {}
    for i, x in enumerate(cols):
        for y in cols[i:]:
            old[x, y] = df.agg(bivariate.pair_corr(x, y) if x != y else F.when(F.stddev_samp(x) > 0, F.lit(1.0))).first()[0]
    got = {(r["col_a"], r["col_b"]): r["r"] for r in bivariate.corr_long(df, cols, mirror=False).collect()}
    assert got.keys() == old.keys()
    for pair, r in old.items():
        assert got[pair] == (None if r is None else pytest.approx(r, abs=1e-9, nan_ok=True)), pair


def test_quantiles_collected_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double, d double, e double")
    monkeypatch.setattr(selection, "COLLECT_CAP", 130)  # before, the targets' sum passed it and no value was found
    got = selection.global_quantiles(df, df.columns, [0.25, 0.75])
    for j, c in enumerate(df.columns):
        assert [got[c][0.25], got[c][0.75]] == pytest.approx(np.quantile(a[:, j], [0.25, 0.75]).tolist())


def test_distinct_rows_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        calls.add(1)
        return x

    base = spark.createDataFrame([(i, float(i % 7)) for i in range(50)] * 2, "k bigint, x double").coalesce(1)
    df = base.select("k", seen("x").alias("x"))
    prep = prepare(df, PrepConfig(order=("duplicates",)), target="x", order_by="k")
    used = calls.value
    assert prep.duplicates_removed == 50 and prep.data.count() == 50 and calls.value == used  # not computed again
