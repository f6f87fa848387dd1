"""Positions and running sums per segment over several ranges, and what is built on them."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kiln.functions import ordering
from kiln.operators import evaluate, split


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 300)


def hot_table(spark, rows=3000):
    """A hot segment of half the rows, a missing one, and many small ones."""
    seg = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 701).cast("string")))
    return spark.range(rows).select("id", seg.alias("a.b"), F.expr("(id * 7919) % 3001").alias("o"))


def test_segment_index_over_ranges(spark, small_ranges):
    rows = ordering.segment_index(hot_table(spark), "a.b", ["o", "id"], "i").collect()
    assert len(rows) == 3000
    groups = defaultdict(list)
    for r in rows:
        groups[r["a.b"]].append(r)
    assert len(groups["hot"]) == 1500 and len(groups) > 500
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r["o"], r["id"]))
        assert [r["i"] for r in ordered] == list(range(len(members)))


@pytest.mark.parametrize("inclusive", [True, False])
def test_segment_running_sum_over_ranges(spark, small_ranges, inclusive):
    rows = ordering.segment_running_sum(hot_table(spark), "a.b", "o", "id", "s", inclusive).collect()
    total = defaultdict(int)
    for r in sorted(rows, key=lambda r: r["o"]):
        before = total[r["a.b"]]
        total[r["a.b"]] += r["id"]
        assert r["s"] == (total[r["a.b"]] if inclusive else before)


def digest(key):
    return hashlib.md5(f"42|{key}".encode()).hexdigest()


def test_twenty_thousand_classes_split_and_fold(spark):
    df = spark.range(60_000).select(F.col("id").alias("k"), F.when(F.col("id") < 20_000, F.lit(-1)).otherwise(F.col("id") % 20_000).alias("c"))
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["c"]].append(r["k"])
    for members in groups.values():
        members.sort(key=digest)
    assert len(groups) == 20_001 and len(groups[-1]) == 20_000
    alloc = split._allocate({c: len(m) for c, m in groups.items()}, math.ceil(60_000 * 0.2))
    want = {k for c, m in groups.items() for k in m[:alloc[c]]}
    got = {r["k"] for r in split.split_flags(df, ["k"], 0.2, 42, stratify="c").where("is_test").collect()}
    assert got == want and len(got) == 12_000
    folds = {r["k"]: r["fold"] for r in split.assign_folds(df, 5, ["k"], stratify="c").collect()}
    assert folds == {k: i % 5 for m in groups.values() for i, k in enumerate(m)}


def test_missing_class_is_a_class(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 100).alias("c"))
    out = split.split_flags(df, ["k"], 0.25, 42, stratify="c").groupBy("c").agg(F.count_if("is_test").alias("t")).collect()
    assert {r["c"]: r["t"] for r in out}[None] == 25 and sum(r["t"] for r in out) == 100


def auc(scores):
    pos, neg = [s for s, p in scores if p], [s for s, p in scores if not p]
    return Fraction(sum((2 if a > b else 1 if a == b else 0) for a in pos for b in neg), 2 * len(pos) * len(neg))


def test_one_vs_rest_auc_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 40)
    rows = [(c, float((i * 37 + c * 11) % 53), (i * 13 + c) % 3 == 0) for c in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "`class` int, score double, is_pos boolean")
    by = defaultdict(list)
    for c, s, p in rows:
        by[c].append((s, p))
    support = {c: sum(p for _, p in v) for c, v in by.items()}
    want = sum(auc(v) * support[c] for c, v in by.items()) / sum(support.values())
    assert evaluate.roc_auc_ovr_long(df).first()["auc"] == pytest.approx(float(want))
    assert evaluate.roc_auc_ovr_long(df, weighted=False).first()["auc"] == pytest.approx(float(sum(map(auc, by.values())) / 5))


def test_auc_from_probability_vectors(spark):
    from pyspark.ml.functions import array_to_vector
    rows = [("a", [0.7, 0.2, 0.1]), ("b", [0.3, 0.4, 0.3]), ("c", [0.2, 0.5, 0.3]), ("a", [0.3, 0.3, 0.4]), ("c", [0.1, 0.1, 0.8])]
    df = spark.createDataFrame(rows, "y string, p array<double>").withColumn("p", array_to_vector("p"))
    want = sum(auc([(p[i], y == c) for y, p in rows]) * sum(y == c for y, _ in rows) for i, c in enumerate("abc")) / 5
    assert evaluate.roc_auc_ovr(df, "y", "p", ["a", "b", "c"]).first()["auc"] == pytest.approx(float(want))
