"""Vectorised text helpers against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kiln.llm import textnp as T

WORDS = ["a", "B", "Ünï", "x" * 40, "don't", "é", "\U0001F600", "1.5", " "]
GAPS = [" ", "\n", "\t\r", "  ", "\x0b\x0c"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    out = [None, "", " ", "\n \t", "one", "one two three four", "A b c D e", "x" * 5000]
    for _ in range(n):
        out.append("".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randint(0, 30))))
    return out


def plain_words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_words_and_hashes(limit):
    values, seen, got = texts(), {}, []
    for first, end, data, offsets in T.slices(pa.array(values), limit):
        low = T.lower(data)
        starts, ends, counts = T.word_spans(low, offsets)
        spans = [bytes(low[a:b]) for a, b in zip(starts, ends, strict=True)]
        hashes = T.span_hashes(low, starts, ends).tolist()
        for s, h in zip(spans, hashes, strict=True):
            assert seen.setdefault(s, h) == h
        bounds = np.concatenate([[0], np.cumsum(counts)])
        got += [spans[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert end - first == len(counts)
    assert got == [[w.lower() for w in plain_words(t)] for t in values]
    assert len(set(seen.values())) == len(seen)


def test_sliced_and_null_columns():
    column = pa.array(["zero", None, "one two", ""]).slice(1)
    data, offsets = T.text_bytes(column)
    assert bytes(data) == b"one two" and offsets.tolist() == [0, 0, 7, 7]
    assert list(T.slices(pa.array([], pa.string()))) == []


def test_shingles_are_distinct_word_runs():
    values = texts()
    for _, _, data, offsets in T.slices(pa.array(values)):
        starts, ends, counts = T.word_spans(data, offsets)
        h, rows = T.shingles(T.span_hashes(data, starts, ends), counts)
        sets, sizes = T.distinct_by_row(h, rows, len(counts))
    known = {}
    at = 0
    for text, n in zip(values, sizes.tolist(), strict=True):
        w = plain_words(text)
        runs = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        mine = sets[at:at + n].tolist()
        at += n
        assert len(runs) == n == len(set(mine)) and mine == sorted(mine)
        key = frozenset(runs)
        assert known.setdefault(key, mine) == mine
