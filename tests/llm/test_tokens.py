"""Encoder, token files, packing and counting transducers against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kiln.llm import packing, token_files
from kiln.llm import textnp as T
from kiln.llm.count_transducer import CountTransducer, starts_of, symbols, token_counts
from kiln.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
BITS = ["a", "b", "the", "'s", "'re", "'ll", "'v", "'", "'d", " ", "  ", "\n", "\t", "1", "23", "!", "é", "ß", "中", " ", "　", "<|endoftext|>",
        "'t", "E", "\U0001F600", "́", "-", "'ve", "ing", " word", "\x1c", "\x85", "²", "ª", " ", "<|startoftext|>", "\x00", "q" * 70]


def strange(n=1500, seed=4):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "x" * 3000, " " * 500] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    texts = [t or "" for t in strange()]
    enc = Encoder(path)
    assert enc.cut is not None
    for _ in range(2):  # cold and from memory
        ids, counts = enc.encode([t.encode() for t in texts], 0)
        want = [e.ids + [0] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_transducer_equals_the_library():
    texts = strange(4000)
    machine, got = CountTransducer(BYTE), []
    for _, _, data, offsets in T.slices(pa.array(texts), 3000):
        got += machine.count_rows(data, offsets).tolist()
    assert got == [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1000])
def test_chunk_maps_compose_to_the_same_starts(chunk):
    text = "".join(t or "" for t in strange(200))
    points = np.array([ord(c) for c in text], dtype=np.int64)
    first = np.zeros(len(points), dtype=bool)
    first[[0, 50, 51]] = True
    symbol = symbols(points, first)
    assert (starts_of(symbol, chunk) == starts_of(symbol, len(symbol))).all()


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        CountTransducer(WORD)


def frame(spark, texts):
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids_crc32 string, deal int").repartition(4)


def test_token_counts_rows(spark):
    texts = strange(100)
    got = token_counts(frame(spark, texts), BYTE, limit=5).collect()
    tok = Tokenizer.from_file(BYTE)
    want = sorted(((i if i % 50 else None, len((t or "").encode()), len(n), len(n) > 5) for i, t in enumerate(texts, 1)
                   for n in [tok.encode(t or "", add_special_tokens=False).ids]), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert token_counts(frame(spark, [""]).where(F.lit(False)), BYTE).collect() == []


@pytest.mark.parametrize("shard_docs, block_bytes", [(25_000, 1 << 20), (13, 200)])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, shard_docs, block_bytes):
    monkeypatch.setattr(token_files, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(token_files, "BLOCK_BYTES", block_bytes)
    texts = strange(120) + ["repeated"] * 3
    df = frame(spark, texts).unionByName(frame(spark, ["again", "again"]))
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, BYTE, end=7)
    tok = Tokenizer.from_file(BYTE)
    rows = sorted(((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [7]) for r in df.collect()),
                  key=lambda x: (x[0] is not None, x[0], len(x[1])))
    back = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == [i for i, _ in rows]
    assert sorted(map(str, ((r.doc_id, list(r.ids)) for r in back))) == sorted(map(str, rows))
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist()
    crc = {(r.start, r.ids_crc32, r.n_tokens) for r in token_files.read_token_files(spark, path, digest=True).collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4")), len(r.ids)) for r in back}
    one = token_files.read_token_files(spark, path, doc_ids=[9]).collect()
    assert [list(r.ids) for r in one] == [list(r.ids) for r in back if r.doc_id == 9]


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(frame(spark, [""]).where(F.lit(False)), path, BYTE)
    assert token_files.read_token_files(spark, path).collect() == []


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    texts = strange(150) + ["word " * n for n in (10, 2047, 2048, 2049, 5000)]
    df = frame(spark, texts)
    tok = Tokenizer.from_file(WORD)
    want = sorted(map(str, ((i if i % 50 else None, s // 2048, s, len(x), zlib.crc32(np.array(x, "<u4"))) for i, t in enumerate(texts, 1)
                            for ids in [tok.encode(t or "", add_special_tokens=False).ids + [0]] for s in range(0, len(ids), 2048) for x in [ids[s:s + 2048]])))
    got = packing.packed(df, WORD).toPandas()
    plain = got.astype(object).where(got.notna(), None)
    assert sorted(map(str, ((None if r.doc_id is None else int(r.doc_id), int(r.piece), int(r.start), int(r.length), int(r.ids_crc32)) for r in plain.itertuples()))) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.cumsum([0, *g["length"]])[:-1].tolist() and g["length"].sum() <= 2048
    assert packing.packed(df.where(F.lit(False)), WORD).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_local_search_never_loses_and_fills_better(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [30, 60, 100][seed % 3] + 1, 400).tolist()
    bins = packing.pack(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    fit = []  # best-fit decreasing alone
    for n in sorted(lengths, reverse=True):
        room = [k for k in range(len(fit)) if fit[k] + n <= 100]
        if room:
            fit[max(room, key=lambda k: fit[k])] += n
        else:
            fit.append(n)
    assert -(-sum(lengths) // 100) <= len(bins) <= len(fit)


def test_local_search_empties_a_bin():
    # best-fit decreasing takes 3 bins for what fits 2
    lengths = [6, 6, 5, 4, 4, 5]
    assert len(packing.pack(lengths, 15)) == 2


def test_new_words_do_not_go_through_the_whole_library_pipeline():
    """Words of common letters go to the model by their pre-tokens; the rest, as special strings, to the library."""
    enc = Encoder(WORD)
    texts = ["Don't STOP'S ''re a'll,x'D 12a3 ÀÉÿß## O'REILLY zzyqk,%%", "<|endoftext|>a œuf ×2 \x1cb", "<|ENDOFTEXT|>"]
    asked = []
    library = enc.tokenizer

    class Asked:
        def encode_batch_fast(self, some, **how):
            asked.extend(some)
            return library.encode_batch_fast(some, **how)
    enc.tokenizer = Asked()
    ids, counts = enc.encode([t.encode() for t in texts], 0)
    want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert set(asked) == {"<|endoftext|>a", "œuf", "×2", "\x1cb"}


def test_workers_of_the_block_stage_hold_no_tokenizer(monkeypatch):
    from kiln.llm import tokens
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    tokens.encoder(BYTE)
    assert list(token_files._decoded(b"", "<u2", 0, True)(iter([]))) == [] and tokens._ENCODERS == {}
