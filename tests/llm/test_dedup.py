"""Near-duplicates: brute-force components, edge cases, signatures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kiln.llm import minhash_dedup as M
from kiln.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, rep string, bands int"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for x, (i, a) in enumerate(flat):
        for j, b in flat[x + 1:]:
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in sets}


def corpus(seed=1):
    """Copies, near copies, chains of near copies, a large loose group, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    rows = [(1000, None), (1001, ""), (1002, "  \n"), (1003, "Two words"), (1004, "two  WORDS"), (1005, "two words more"), (1006, "x " * 3000), (1007, "x x x x x")]
    i = 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 4)):
            rows.append((i, " ".join(base)))
            i += 1
            base = base[:]
            base[rng.randrange(len(base))] = word()
    loose = [word() for _ in range(80)]
    for _ in range(150):
        copy = loose[:]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(80)] = word()
        rows.append((i, " ".join(copy)))
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4, 256])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "r", 1) for i, t in rows], SCHEMA).repartition(5)
    got = M.near_duplicates(df).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "q r s t u v"), (7, "q r s t u v"), (9, "z")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)], key=str)
    kept = M.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 5, 9], key=str)


def test_near_copies_of_every_text_of_a_repeated_id_are_linked(spark):
    rng = random.Random(11)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(400)]
    one, two, short = text(), text(), text()[:200]
    rows = [(5, one), (5, two), (9, one[:-5]), (10, two[:-5]), (11, short), (5, []), (12, short[:-4]), (12, text()), (12, text())]
    df = spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in rows], SCHEMA).repartition(3)
    got = {(r.doc_id, r.component_id) for r in M.near_duplicates(df).collect()}
    assert got == {(5, 5), (9, 5), (10, 5), (11, 11), (12, 11)}


def test_large_loose_group_gives_few_links(spark, monkeypatch):
    """What tasks give out stays below the members times the blocks that they meet."""
    monkeypatch.setattr(M, "BLOCK", 64)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        copy = base[:]
        for _ in range(rng.randint(3, 9)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    seen = []
    add = M._Search.add
    monkeypatch.setattr(M._Search, "add", lambda self, links: (seen.append(links.count()), add(self, links)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()} == brute(rows)
    assert len(seen) == 3 and seen[-1] < 400 * 32


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.near_duplicates(df).collect() == [] and M.keep_first(df).collect() == []


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for shared, own in ((900, 50), (60, 4), (6, 1)):
        agree = []
        for _ in range(40):
            h = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
            sets = [np.sort(np.concatenate([h[:shared], h[shared + k * own:shared + (k + 1) * own]])) for k in (0, 1)]
            a, b = (M.signatures(s, np.array([len(s)]))[0] for s in sets)
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - shared / (shared + 2 * own)) < 0.04
    assert (M.signatures(np.zeros(0, np.uint64), np.array([0]))[0] == 0).all()


@pytest.mark.parametrize("shared, own", [(221, 39), (272, 48), (340, 60), (408, 72), (442, 78), (476, 84), (510, 90)])
def test_sketch_filter_keeps_pairs_at_the_threshold(shared, own):
    """Pairs of exactly 85 % similarity with 240 to 555 shingles all reach the exact check."""
    rng, m = np.random.default_rng(shared), 3000
    h = rng.integers(0, 1 << 64, (m, shared + own), dtype=np.uint64)
    half = shared + own // 2
    sets = [np.sort(h[:, :half], axis=1), np.sort(np.concatenate([h[:, :shared], h[:, half:]], axis=1), axis=1)]
    n = [np.full(m, x.shape[1]) for x in sets]
    sig = [M.signatures(x.ravel(), k) for x, k in zip(sets, n, strict=True)]
    ids = pa.array(np.arange(m))
    batch = pa.RecordBatch.from_arrays([ids, ids, *[pa.array([x.tobytes() for x in s], pa.binary()) for s in sig], *map(pa.array, n)],
                                       names=["a", "b", "sa", "sb", "na", "nb"])
    assert sum(b.num_rows for b in M._hopeful(iter([batch]))) == m


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(300, 300), (7, 3), (3, 7), (None, 2)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(60)} | {300: 300}
    assert components(df.where(F.lit(False))).collect() == []
