"""Driver contract: entry runs, every oracle has a query, a sample of queries match DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tests.oracle_check import TABLES, canon

SAMPLE = ["profile_and_clean_events", "profile_columns", "fill_median_mode", "histogram", "box_by_category",
          "corr_pairs", "one_hot_segment", "split_stratified", "classification_report", "knn_vote"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["event_type", "n", "event_type_freq", "mean_value", "skew_value"]


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle_sf0001(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert canon(srows, sdf.columns) == canon(cur.fetchall(), ocols)


def test_streaming_applies_batch_fit(spark, tmp_path):
    from pyspark.sql import functions as F

    from kiln.operators import clean
    from kiln.streaming.apply import apply_fitted, missing_counts_stream
    batch = spark.read.parquet(f"{SF001}/events.parquet").select("event_id", "value")
    batch = batch.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    fill = clean.fit_fill(batch, "median", ["value"])
    import shutil
    src = tmp_path / "src"
    src.mkdir()
    shutil.copy(f"{SF001}/events.parquet", src / "part-0.parquet")
    full = spark.read.parquet(f"{SF001}/events.parquet")
    stream = spark.readStream.schema(full.schema).parquet(str(src)).select("event_id", "value")
    stream = stream.withColumn("value", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))
    q = (missing_counts_stream(apply_fitted(stream, fill)).writeStream.outputMode("complete")
         .format("memory").queryName("kiln_stream_test")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM kiln_stream_test").first()
    assert r["n_rows"] == batch.count() and r["value_missing"] == 0


def test_kmeans_sweep_runs_the_whole_job(monkeypatch):
    import inspect

    from kiln.plans import catalog_learn as L
    seen = {}
    signature = inspect.signature(L.unsupervised.kmeans_sweep)

    def sweep(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)

    monkeypatch.setattr(L.unsupervised, "kmeans_sweep", sweep)
    monkeypatch.setattr(L.unsupervised, "cluster_leaderboard", lambda rows: rows)
    monkeypatch.setattr(L, "_cluster_input", lambda *a: None)
    monkeypatch.setattr(L, "_round_doubles", lambda rows: rows)
    L.q_kmeans_sweep(None, None)
    assert (seen["k_min"], seen["k_max"], seen["n_init"]) == (2, 8, 10)


def test_before_after_refits_the_best_scored_setting(spark, monkeypatch):
    from kiln.plans import catalog_learn as L
    refit, search = {}, {}

    def scored(df, features, problem_type, scaler, spec, n_iter, **kw):
        combos = L.models.sample_params(spec.grid, n_iter, 42)
        search[spec.name] = (n_iter, combos[-1])
        rows = [(spec.name, str(sorted(p.items())), float(i)) for i, p in enumerate(combos)]
        return spark.createDataFrame(rows, "Model string, params string, cv_score double").orderBy("cv_score", ascending=False)

    monkeypatch.setattr(L.models, "random_search", scored)
    monkeypatch.setattr(L.models, "fit_predict", lambda s, params, *a, **kw: (None, refit.setdefault(s.name, params)))
    monkeypatch.setattr(L.models, "_score", lambda *a, **kw: {"F1": 0.5, "Accuracy": 0.5})
    monkeypatch.setattr(L.models, "baseline_leaderboard", lambda *a, **kw: None)
    monkeypatch.setattr(L.models, "leaderboard_frame", lambda *a, **kw: None)
    monkeypatch.setattr(L.models, "before_after", lambda *a, **kw: None)
    monkeypatch.setattr(L, "_round_doubles", lambda rows: rows)
    L.q_before_after(spark, SF001)
    assert {k: v[0] for k, v in search.items()} == {"Logistic Regression": 12, "Decision Tree": 12}
    assert refit == {k: v[1] for k, v in search.items()}
