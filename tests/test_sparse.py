"""Sparse one-hot rows against dense columns, many levels, and what fits make of them."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kiln.operators import encode, sparse, unsupervised


def small(spark):
    rows = [(1, "b", "x", 1.0, 5), (2, "a", None, None, 5), (3, None, "y", 3.0, 5), (4, "a", "x", 9.0, 5), (5, "c", "x", float("inf"), 5)]
    return spark.createDataFrame(rows, "id int, `t.1` string, u string, n double, flat int").withColumn("dead", F.lit(None).cast("string"))


def dense(df):
    return {r["id"]: list(r["v"]) for r in sparse.as_vectors(df).select("id", vector_to_array("features").alias("v")).collect()}


@pytest.mark.parametrize("drop_first", [True, False])
def test_same_cells_as_dense_one_hot(spark, drop_first):
    df = small(spark).select("id", F.col("`t.1`").alias("t"), "u")
    wide = encode.one_hot(encode.one_hot(df, "t", drop_first), "u", drop_first)
    want = {r["id"]: [float(x) for x in r[1:]] for r in wide.collect()}
    assert dense(sparse.one_hot_sparse(df, ["t", "u"], drop_first)) == want


def test_matrix_has_the_cells_of_the_dense_matrix(spark):
    df = small(spark).withColumnRenamed("t.1", "t")
    wide = unsupervised.unsupervised_matrix(df, "id")
    filled, encoder = sparse.fill_and_fit(df, "id")
    names = [r["name"] for r in encoder.names().orderBy("slot").collect()]
    assert names == [c for c in wide.columns if c != "id"]
    assert dense(sparse.sparse_matrix(df, "id")) == {r["id"]: list(r[1:]) for r in wide.collect()}


def test_fifty_thousand_levels(spark):
    df = spark.range(120_000).select("id", F.concat(F.lit("v"), (F.col("id") % 50_000).cast("string")).alias("c"))
    out = sparse.one_hot_sparse(df, ["c"], drop_first=False)
    per = out.select(F.size("features.indices").alias("ones"), F.explode("features.indices").alias("slot"), "features.size")
    counts = per.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.max("ones").alias("m"), F.max("size").alias("size"))
    got = {(r["n"], r["m"], r["size"]): r["k"] for r in counts.groupBy("n", "m", "size").agg(F.count(F.lit(1)).alias("k")).collect()}
    assert got == {(3, 1, 50_000): 20_000, (2, 1, 50_000): 30_000}
    with pytest.raises(ValueError):
        encode.one_hot(df, "c")


def test_new_rows_with_unseen_levels_and_names_with_dots(spark):
    encoder = sparse.fit_sparse(small(spark), ["t.1"], ["n"], drop_first=False)
    new = spark.createDataFrame([(1, "zzz", None), (2, "c", 4.0)], "id int, `t.1` string, n double")
    rows = {r["id"]: r["features"] for r in encoder.transform(new).collect()}
    assert rows[1]["indices"] == [0] and rows[1]["values"] == [0.0]
    assert rows[2]["indices"] == [0, 3] and rows[2]["values"] == [4.0, 1.0] and rows[2]["size"] == 4


def test_empty_table_and_clustering(spark):
    from pyspark.ml.clustering import KMeans
    none = small(spark).where("id < 0").select("id", "u")
    assert sparse.as_vectors(sparse.one_hot_sparse(none, ["u"])).collect() == []
    df = spark.range(300).select("id", (F.col("id") % 2 * 100.0).alias("n"), F.concat(F.lit("k"), (F.col("id") % 150).cast("string")).alias("t"))
    vec = sparse.as_vectors(sparse.sparse_matrix(df, "id"))
    lab = KMeans(k=2, seed=1).fit(vec).transform(vec)
    assert lab.groupBy((F.col("id") % 2).alias("p")).agg(F.count_distinct("prediction").alias("k")).agg(F.max("k")).first()[0] == 1
