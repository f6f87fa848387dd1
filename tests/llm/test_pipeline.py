"""The registered queries and the pipeline, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kiln.llm import queries
from tests.conftest import SF001
from tests.oracle_check import TABLES, canon


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got = entry.queries()[name](spark, SF001)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), names)


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_take_effect_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, SF001), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id: r for r in rows}
        assert len(kept[name]) == len(rows) <= before
        before = len(rows)
    judged = {r.doc_id: r.kept for r in entry.queries()["op6_quality_mcd"](spark, SF001).collect()}
    assert set(kept["quality"]) == {i for i, k in judged.items() if k}
    assert any(kept["personal_data"][i].text != r.text for i, r in kept["decontaminate"].items())
    assert set(kept["personal_data"]) == set(kept["decontaminate"])
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"].values())
    out = corpus_pipeline.run(spark, SF001).collect()
    assert {r.doc_id for r in out} == set(kept["personal_data"])
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
