"""Language-model scores and the classifier against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import nb_svm, ppm

# ---- prediction by partial matching


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


class PlainModel:
    def __init__(self, texts):
        top = defaultdict(Counter)
        for t in texts:
            t = bytes([ppm.BEFORE] * ppm.ORDER) + lower(t) + bytes([ppm.END])
            for i in range(ppm.ORDER, len(t)):
                top[t[i - ppm.ORDER:i]][t[i]] += 1
        self.orders = {ppm.ORDER: top}
        for k in range(ppm.ORDER - 1, -1, -1):
            shorter = defaultdict(Counter)
            for c, n in self.orders[k + 1].items():
                for s in n:
                    shorter[c[1:]][s] += 1
            self.orders[k] = shorter

    def log10(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            known = self.orders[k].get(context[len(context) - k:], {})
            left = {s: n for s, n in known.items() if s not in gone}
            if known and left:
                total = sum(left.values())
                if symbol in left:
                    return out + math.log10((2 * left[symbol] - 1) / (2 * total))
                out += math.log10(len(left) / (2 * total))
            gone |= set(known)
        return out - math.log10(255 - len(self.orders[0].get(b"", {})))

    def score(self, text):
        t = bytes([ppm.BEFORE] * ppm.ORDER) + lower(text) + bytes([ppm.END])
        return sum(self.log10(t[i - ppm.ORDER:i], t[i]) for i in range(ppm.ORDER, len(t)))


def texts(n=80, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    out = [None, "", " ", "\n", "Zebra zebra", "b" * 500]
    return out + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))).capitalize() + rng.choice(["", "\n", "!"]) for _ in range(n)]


@pytest.mark.parametrize("chunk", [300, 8 << 20])
def test_scores_match_a_plain_model(spark, monkeypatch, chunk):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", chunk)
    rows = [(i if i else None, t) for i, t in enumerate(texts())] + [(3, "a repeated id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, score string, key int").repartition(4)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    model = PlainModel(train)
    counts = Counter(w for t in train for w in lower(t).split())
    tokens, types = sum(counts.values()) + len(train), len(counts) + 1
    counts[None] = len(train)
    want = []
    for i, t in rows:
        w = [*lower(t).split(), None]
        base = sum(math.log10((counts[x] + 1) / (tokens + types + 1)) for x in w)
        want.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), tokens, round(base, 6), round(model.score(t), 3)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in ppm.score_documents(df).collect()]
    assert sorted(g[:6] for g in got) == sorted(w[:6] for w in want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[6] == pytest.approx(w[6], abs=2e-3)


def test_probabilities_of_a_context_sum_to_one():
    model = PlainModel(texts(30))
    for context in (b"abcda", b"zzzzz", bytes([ppm.BEFORE] * 5), b"a" * 5):
        total = sum(10 ** model.log10(context, s) for s in range(256) if s != ppm.BEFORE)
        assert total == pytest.approx(1, abs=0.01) or total < 1


def test_scores_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.score_documents(df).collect() == []


# ---- classifier

def labelled(n=300, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        good = i % 3 > 0
        w = [word() for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), int(good)))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(None, "x y", "q"), (5000, None, "q"), (5001, "", "q"), (5001, "", "q")],
                                 "doc_id bigint, text string, quality string").repartition(5)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(9999, 1, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id bigint, quality int, toxic int")
    got = nb_svm.classify(docs, labels).collect()
    assert len(got) == len(rows) + 4
    truth = {i: q for i, _, q in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert len(empty) == 1


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows = labelled(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one, two = (spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, _, q in rows], "doc_id bigint, quality int") for flip in (False, True))
    assert sorted(nb_svm.classify(docs, one).collect()) == sorted(nb_svm.classify(docs, two).collect())


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in nb_svm.classify(docs, labels).collect()] == [0.5]
    assert nb_svm.classify(docs.where(F.lit(False)), labels).collect() == []


def test_dual_coordinate_descent_closes_the_gap():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(200)]
    labels = np.where([r.min() < 3 for r in rows], 1.0, -1.0)
    values = [np.ones(len(r)) / math.sqrt(len(r)) for r in rows]
    cost = np.full(200, 1.0)
    w = nb_svm.dual_coordinate_descent(rows, values, labels, cost)
    margin = np.array([y * (w[r] @ v + w[-1]) for r, v, y in zip(rows, values, labels, strict=True)])
    primal = 0.5 * w @ w + np.maximum(0, 1 - margin).sum()
    for _ in range(200):  # no nearby weights do better
        step = np.zeros_like(w)
        step[:40], step[-1] = rng.normal(size=40) * 0.02, rng.normal() * 0.02
        v2 = w + step
        m2 = np.array([y * (v2[r] @ v + v2[-1]) for r, v, y in zip(rows, values, labels, strict=True)])
        assert 0.5 * v2 @ v2 + np.maximum(0, 1 - m2).sum() >= primal - 0.02
