"""Edge-case fixtures (FIXTURES.md section 3) for the preparation operators."""

import math

import pytest
from pyspark.sql import functions as F

from kiln.functions.exprs import finite
from kiln.operators import clean, encode, outliers, profile, select, split, univariate
from kiln.operators.bivariate import corr_long


def test_empty_table_has_no_ids_and_no_text_target(spark):
    df = spark.createDataFrame([], "case_id long, y string")
    assert profile.id_columns(df) == []
    from kiln.operators.textrules import resolve_target
    assert resolve_target(df, "")["target"] is None


def test_all_null_column_dropped(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert clean.drop_all_null_columns(df).columns == ["a"]


def test_nan_and_infinity_become_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,)], "a double")
    vals = [r[0] for r in df.select(finite(F.col("a"))).collect()]
    assert vals == [None, None, None, 1.5]


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0, float(i)) for i in range(30)], "a double, b double")
    h = univariate.histogram(df, "a").collect()
    assert len(h) == 1 and h[0]["n"] == 30
    assert "a" not in outliers.zscore_bounds(df, ["a"])
    assert univariate.numeric_stats(df, ["a"]).first()["skew"] == 0.0
    assert select.zero_variance_columns(df) == ["a"]


def test_tied_mode_smallest_and_unknown_fill(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "c string")
    assert clean.column_mode(df, "c") == "a"
    empty = spark.createDataFrame([(None,), (None,)], "c string")
    assert clean.fit_fill(empty, "median").fills["c"] == "Unknown"


def test_missing_share_exactly_half_is_filled(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,)], "a double")
    p, out = clean.fit_fill_auto(df)
    assert p.drop_subset == [] and out.where("a IS NULL").count() == 0 and out.count() == 4


def test_missing_share_above_half_drops_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (None,), (None,)], "a double")
    p, out = clean.fit_fill_auto(df)
    assert p.drop_subset == ["a"] and out.count() == 1


def test_train_imputer_drops_rows_at_one_percent(spark):
    rows = [(float(i), "x") for i in range(99)] + [(None, "x")]
    tr = spark.createDataFrame(rows, "a double, s string")
    imp = clean.fit_train_imputer(tr, tr, ["a", "s"])
    assert imp.drop_train_rows and imp.transform_train(tr).count() == 99


def test_outlier_mask_keeps_or_drops_missing(spark):
    rows = [(float(i),) for i in range(20)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(rows, "a double")
    kept, _ = outliers.remove_outliers(df, ["a"], "iqr", keep_null=True)
    dropped, _ = outliers.remove_outliers(df, ["a"], "iqr", keep_null=False)
    assert kept.count() == 21 and kept.where("a IS NULL").count() == 1
    assert dropped.count() == 20


def test_onehot_limit_10_vs_frequency_11(spark):
    ten = spark.createDataFrame([(i, f"v{i % 10}") for i in range(40)], "id long, c string")
    eleven = spark.createDataFrame([(i, f"v{i % 11}") for i in range(44)], "id long, c string")
    s10 = encode.fit_encode_table(ten, order_by="id").steps[0][1]
    s11 = encode.fit_encode_table(eleven, order_by="id").steps[0][1]
    assert s10.startswith("One-Hot") and s11.startswith("Frequency")


def test_one_hot_with_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c string")
    out = encode.one_hot(df, "c")
    assert out.columns == ["c_b", "c_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]


def test_boollike_text(spark):
    df = spark.createDataFrame([(" Yes",), ("no",), ("Y",)], "c string")
    assert [r[0] for r in encode.boollike_text(df, "c").collect()] == [1.0, 0.0, 1.0]


def test_problem_type_thresholds(spark):
    df15 = spark.createDataFrame([(float(i % 15),) for i in range(300)], "y double")
    df16 = spark.createDataFrame([(float(i % 16),) for i in range(300)], "y double")
    assert profile.infer_problem_type(df15, "y") == "classification"
    assert profile.infer_problem_type(df16, "y") == "regression"


def test_correlation_exactly_095_is_kept(spark):
    # y = x + noise built so that r is exactly representable near 0.95: use the stored r as threshold
    df = spark.createDataFrame([(float(i), float(i) + (3.0 if i % 2 else -3.0)) for i in range(20)], "x double, y double")
    r = corr_long(df, ["x", "y"], include_diagonal=False, mirror=False).first()["r"]
    assert select.corr_filter_columns(df, ["x", "y"], thr=r) == []
    assert select.corr_filter_columns(df, ["x", "y"], thr=r - 1e-9) == ["y"]


def test_class_with_one_row_falls_back_to_random_split(spark):
    rows = [(i, "a") for i in range(19)] + [(19, "b")]
    df = spark.createDataFrame(rows, "id long, t string")
    tr, te = split.split_stratified(df, "t", ["id"], 0.2)
    assert te.count() == 4 and tr.count() == 16


def test_fold_count_rules(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id long, t string")
    assert split.fold_count(df, 5, "t") == 3
    one = spark.createDataFrame([(0, "a"), (1, "b")], "id long, t string")
    assert split.fold_count(one, 5, "t") == 0


def test_imbalance_ratio_060_does_not_resample(spark):
    df = spark.createDataFrame([(i, 0 if i < 6 else 1) for i in range(16)], "id long, y int")
    rows = split.class_balance(df, "y").collect()
    assert rows[0]["ratio"] == pytest.approx(0.6) and not rows[0]["resample"]


def test_clustering_guard(spark):
    from kiln.operators.unsupervised import enough_for_clustering
    small = spark.createDataFrame([(float(i), float(i)) for i in range(9)], "a double, b double")
    assert not enough_for_clustering(small, ["a", "b"])
    assert not enough_for_clustering(small, ["a"])


def test_dbscan_all_noise(spark):
    from kiln.operators.density import dbscan
    df = spark.createDataFrame([(i, [float(i * 10), 0.0]) for i in range(12)], "id long, v array<double>")
    out = dbscan(df, "id", "v", eps=0.5, min_samples=3)
    assert {r["cluster"] for r in out.collect()} == {-1}


def test_split_sizes_disjoint_covering(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    tr, te = split.split_random(df, ["k"], 0.2, 7)
    a = {r[0] for r in tr.collect()}
    b = {r[0] for r in te.collect()}
    assert len(b) == math.ceil(1001 * 0.2) and not (a & b) and len(a | b) == 1001


def test_split_tie_path_matches_md5_order(spark, monkeypatch):
    """Coarse hash prefixes force many ties at the cut; the full digest must settle them."""
    import hashlib

    from kiln.functions import exprs
    coarse = lambda keys, seed=42: F.floor(exprs.hash_unit(keys, seed) * 8) / 8
    monkeypatch.setattr(split, "hash_unit", coarse)
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string")
    out = {r["id"]: r["is_test"] for r in split.split_flags(df, ["id"], 0.2, 42, stratify="t").collect()}
    counts = {"a": 200, "b": 100}
    alloc = split._allocate(counts, math.ceil(300 * 0.2))
    for cls in ("a", "b"):
        ids = [i for i, t in rows if t == cls]
        ids.sort(key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        want = set(ids[:alloc[cls]])
        assert {i for i in ids if out[i]} == want


def test_unsupervised_matrix_keeps_every_level(spark):
    from kiln.operators import unsupervised
    rows = [(i, f"v{i % 60:02d}", float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, c string, x double")
    mat = unsupervised.unsupervised_matrix(df, id_col="id")
    # 60 levels, first dropped: all 59 indicator columns survive (no level cap)
    assert len([c for c in mat.columns if c.startswith("c_")]) == 59


def test_one_hot_levels_over_bound_raise_not_truncate(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(5)], "c string")
    assert encode.fit_one_hot_levels(df, "c", 5) == [f"v{i}" for i in range(5)]
    with pytest.raises(ValueError):
        encode.fit_one_hot_levels(df, "c", 3)


def test_class_counts_bound_raises(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, y long")
    assert split.class_counts(df, "y") == {k: 10 for k in range(5)}
    monkeypatch.setattr(split, "MAX_CLASSES", 4)
    with pytest.raises(ValueError):
        split.class_counts(df, "y")
    # the class-balance report needs no class table on the driver
    rows = {r["class"]: r["n"] for r in split.class_balance(df, "y").collect()}
    assert rows == {str(k): 10 for k in range(5)}
