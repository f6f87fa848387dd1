"""The column a text points at: joined vocabulary matches against difflib text by text."""

import difflib
import re

import pytest

from kiln.operators import textrules as R
from kiln.plans.fixtures import table

from conftest import SF001

COLUMNS = ["l_quantity", "l_shipdate", "quality", "label", "o_orderpriority", "Churn", "x1", "order total", "label_2"]
TEXTS = ["", None, "predict the quality of a label", "the QUALITTY of ordr totals", "orderpriority and shipdates", "x1 x1 churned",
         "order total, label_2", "nothing to see", "labels " * 5000 + "churn", "İstanbul quality", "1234 __ --", "quantity"]


def brute(text):
    """Each column's score by the rules, read off one text."""
    raw = (text or "").lower()
    words = set(re.findall(r"[a-z_]+", raw))
    like = lambda target, cut: any(difflib.SequenceMatcher(None, w, target).ratio() >= cut for w in words)
    scores = []
    for c in COLUMNS:
        parts = re.findall(r"[a-z_]+", c.lower())
        scores.append(6.0 * (c.lower() in raw) + 3.0 * like(c.lower(), 0.75) + sum(2.0 for p in parts if len(p) >= 3 and p in words)
                      + sum(1.5 for p in parts if len(p) >= 4 and like(p, 0.8)))
    order = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-scores[i], i))
    if not order:
        return None, 0.0, 0.0, []
    top = [scores[i] for i in order[:2]] + [0.0]
    return COLUMNS[order[0]], top[0], top[0] / (top[0] + top[1]), [COLUMNS[i] for i in order[1:]]


def test_scores_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = R.score_target_columns(spark.createDataFrame(rows, "id int, text string"), "text", "id", COLUMNS).collect()
    got = {r["id"]: (r["target"], r["score"], r["confidence"], r["alternatives"]) for r in out}
    for i, t in rows:
        want = brute(t)
        assert got[i][0] == want[0] and got[i][3] == want[3], (t[:50] if t else t, got[i], want)
        assert got[i][1:3] == pytest.approx(want[1:3])


def test_documents_equal_brute_force(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = R.score_target_columns(docs, "text", "doc_id", COLUMNS).collect()
    assert len(out) == docs.count()
    for r in sorted(out, key=lambda r: r["doc_id"])[:60]:
        assert (r["target"], r["score"]) == brute(texts[r["doc_id"]])[:2]
    assert all(0.0 <= r["confidence"] <= 1.0 for r in out)


def test_repeated_and_missing_ids_and_no_columns(spark):
    df = spark.createDataFrame([(1, "quality"), (1, "churn"), (None, "label"), (None, "label"), (2, "quality")], "id int, text string")
    got = sorted((r["id"] or 0, r["target"]) for r in R.score_target_columns(df, "text", "id", COLUMNS).collect())
    assert got == [(0, "label"), (0, "label"), (1, "Churn"), (1, "quality"), (2, "quality")]
    assert [r["confidence"] for r in R.score_target_columns(df, "text", "id", []).collect()] == [0.0] * 5


def test_resolver(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i), i % 3) for i in range(100)], "key int, churn string, price double, grade int")  # equal scores keep column order
    got = R.resolve_target(df, "predict churn from the price")
    assert (got["learning_type"], got["task_type"], got["target"]) == ("supervised", "classification", "churn")
    assert got["alternatives"] == ["price"] and got["confidence"] == 0.5
    assert R.resolve_target(df, "estimate price")["task_type"] == "regression"
    hinted = R.resolve_target(df, "predict churn", hint="grade")
    assert (hinted["target"], hinted["confidence"], hinted["alternatives"]) == ("grade", 1.0, ["churn"])
    loose = R.resolve_target(df, "forecast it")
    assert loose["target"] is not None and loose["confidence"] == 0.0 and loose["alternatives"] == []
    assert R.resolve_target(df, "find groups") == {"learning_type": "unsupervised", "task_type": "unsupervised", "target": None,
                                                   "confidence": 0.0, "alternatives": []}


def test_plan_has_no_python_over_texts(spark, capsys):
    docs = table(spark, SF001, "documents").select("doc_id", "text")
    R.score_target_columns(docs, "text", "doc_id", COLUMNS).explain("formatted")
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan
    assert len(re.findall(r"\) MapInPandas[^\n]*\nInput", plan)) == 1
    assert re.search(r"\) MapInPandas[^\n]*\nInput \[1\]: \[word#", plan)


def test_numeric_column_without_values_is_a_candidate(spark):
    from kiln.operators.profile import candidate_targets
    df = spark.createDataFrame([(None, i * 1.0) for i in range(40)], "empty int, price double")
    assert candidate_targets(df, variant="auto") == ["empty"]


def test_words_of_the_texts_are_not_shuffled_for_their_clues(spark, monkeypatch):
    """The words that point at a column are few: they go to the texts, by any of both joins with the same result."""
    from kiln.operators import textrules
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["the price of it", "order status pric", "nothing", None, "o_status o_status"] * 4)], "id int, text string")
    found = textrules.score_target_columns(df, "text", "id", ["o_status", "price"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    few = sorted(map(str, found.collect()))
    monkeypatch.setattr(textrules, "BROADCAST_ROWS", 0)
    assert sorted(map(str, textrules.score_target_columns(df, "text", "id", ["o_status", "price"]).collect())) == few
