"""Hard negatives, importance resampling and WARC archives against brute force, and their edge cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import hard_negatives as H
from kiln.llm import importance as I
from kiln.llm import warc as W

# ---- hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, uid string, rank int, q int"


def vectors(n=400, dim=6, seed=3):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) + (k == i % 3) for k in range(dim)], i % 4, "x", 1, 2) for i in range(n)]
    rows[7] = rows[8] = (50, [0.5] * dim, 1, "x", 1, 2)              # a repeated anchor
    rows += [(n + i, [0.25] * dim, 2, None, None, None) for i in range(60)]  # ties
    rows += [(1000, None, 1, "x", 1, 2), (1050, [float("nan")] + [1.0] * 5, 1, "x", 1, 2), (1100, [None] + [1.0] * 5, 1, "x", 1, 2),
             (1150, [1.0] * 6, None, "x", 1, 2), (None, [1.0] * 6, 1, "x", 1, 2), (1200, [float("inf")] + [1.0] * 5, 1, "x", 1, 2),
             (1250, [0.0] * 6, 1, "x", 1, 2), (1300, [], 2, "x", 1, 2), (1350, [1.0, 2.0], 3, "x", 1, 2)]
    return rows


def brute_negatives(rows):
    clean = []
    for u, (i, x, label, *_) in enumerate(rows):
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        q = [math.floor(256 * float(np.float32(c))) for c in x]
        clean.append((u, i, label, q + [0] * (6 - len(q))))
    out = []
    for u, i, label, q in clean:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), j, lab, v) for v, j, lab, p in clean if v != u]
        for s, j, _, _ in sorted((x for x in scored if x[2] == label), key=lambda x: x[:2])[:5]:
            fits = sorted(x[:2] for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(i, j, k + 1, m, -s, -t) for k, (t, m) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 64)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    rows = vectors()
    got = H.mine_embeddings(spark.createDataFrame(rows, VECTORS)).drop("positive_rank").collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_hard_negatives_empty_and_alone(spark):
    assert H.mine_embeddings(spark.createDataFrame([], VECTORS)).count() == 0
    assert H.mine_embeddings(spark.createDataFrame([(1, [1.0], 0, "", 0, 0)], VECTORS)).count() == 0  # no anchor
    assert H.mine_embeddings(spark.createDataFrame([(0, [1.0], 0, "", 0, 0)], VECTORS)).count() == 0  # no other row


def test_score_bounds_hold_and_filter():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16)) * 300
    m = np.floor(centres[r.integers(0, 6, 2000)] + r.normal(size=(2000, 16)) * 20)
    m[:5] = 0
    refs = H.reference_directions(m)
    norm = np.linalg.norm(m, axis=1)
    t = np.arccos(np.clip(m @ refs.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)).astype("<f4").T
    let_through = 0
    for i in range(0, 200):
        low, high = H.score_bounds(t[:, i], norm[i], t, norm)
        s = m @ m[i]
        assert (low <= s).all() and (s <= high).all()
        let_through += ((high >= 0.9 * norm[i] ** 2)).sum()
    assert let_through < 0.5 * 200 * 2000  # clustered rows: most are never scored


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="32 bits"):
        H.mine_embeddings(spark.createDataFrame([(0, [1e30, 1.0], 0, "", 0, 0)], VECTORS)).count()


# ---- importance resampling

def test_span_crc32_equals_zlib():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = r.integers(0, 4000, 300)
    ends = starts + np.concatenate([r.integers(0, 40, 280), [0, 1, 31, 32, 33, 63, 64, 65, 96, 97, 500, 777, 1000, 31, 32, 33, 128, 129, 127, 2]])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert I.span_crc32(data, starts, ends).tolist() == want
    assert len(I.span_crc32(data, starts[:0], ends[:0])) == 0


DOCS = "doc_id bigint, text string, lang string, weight string, rank string, n string, bucket int"


def corpus():
    r = random.Random(4)
    words = ["alpha", "Beta", "naïve", "x1", "日本", "w" * 70, "épée", "zeta9"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 45))) + r.choice(["", ".", "-!"]), "", "", "", "", 1) for i in range(150)]
    rows += [(200, None, None, None, None, None, None), (201, "", "", "", "", "", 1), (202, "!?\x00.", "", "", "", "", 1),
             (203, "alpha " * 20_000, "", "", "", "", 1), (None, "beta " * 30, "", "", "", "", 1), (204, "q" * 300_000, "", "", "", "", 1)]
    return rows + [rows[3], rows[3]]


def brute_resample(docs, target, n):
    feats = lambda t: (lambda w: [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)])(
        re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) and
        [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))])
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for d in docs:
        s.update(map(bucket, feats(d[1])))
    for d in target:
        t.update(map(bucket, feats(d[1])))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d in docs:
        f = feats(d[1])
        words = sum(" " not in x for x in f)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append([d[0], len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    may = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): i + 1 for i, x in enumerate(may[:len(may) * 10 // 100])}
    return Counter((x[0], x[1], x[2], x[3], rank.get(id(x))) for x in out)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, n):
    docs, target = corpus(), [(0, "alpha beta Beta épée"), (1, None), (2, "zeta9 " * 50)]
    got = I.resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(target, "item_id bigint, text string"), n=n)
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == brute_resample(docs, target, n)


def test_resampling_empty(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame(corpus()[:30], DOCS)
    assert I.resample(none, one).count() == 0
    assert I.resample(one, none).count() == 30


# ---- WARC

PAGES = "page_id bigint, url string, html string, digest string, bytes int, row int, value string, kept_page int"


def pages():
    r = random.Random(9)
    tricky = ["x\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r", "\n", "\r\n", "\r\n\r\n", "a\r\r\n\r\n", "\r\n\r", "é\r\n\r\n\r\n", "", None,
              "x" * 300_000 + "\r\n\r\n" + "y" * 100_000]
    rows = [(i, f"http://h/{i}", "".join(r.choices("\r\nab", k=r.randint(0, 12))), "", 1, 1, "", 1) for i in range(300)]
    rows += [(400 + i, None if i == 3 else "http://h/\r\nX-Page-Id: 5", t, "", 1, 1, "", 1) for i, t in enumerate(tricky)]
    rows += [(500, "u", "same", "", 1, 1, "", 1), (500, "u", "same", "", 1, 1, "", 1), (None, "u", "same", "", 1, 1, "", 1), (None, "v", "alone", "", 1, 1, "", 1)]
    return rows + [(600 + i, "hot", "hot payload \r\n\r\n", None, None, None, None, None) for i in range(200)]


def brute_warc(rows, least):
    largest, n = {}, Counter()
    for i, _, html, *_ in rows:
        t = html or ""
        largest[t] = max(largest.get(t, -1), -1 if i is None else i)
        n[t] += 1
    out, taken = Counter(), set()
    for i, _, html, *_ in rows:
        t = html or ""
        b = t.encode()
        revisit = len(b) >= least and n[t] > 1 and ((-1 if i is None else i) < largest[t] or t in taken)
        if not revisit:
            taken.add(t)
        out[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", largest[t] if revisit else None, b] += 1
    return out


@pytest.mark.parametrize("least", [0, 3])
def test_archives_round_trip(spark, tmp_path, least):
    rows = pages()
    W.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), str(tmp_path / "a"), least)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    got = W.read_archives(spark, str(tmp_path / "a")).select(cols).collect()
    assert Counter((*r[:5], bytes(r[5])) for r in got) == brute_warc(rows, least)
    # resolved and written anew: the same pages, and each payload once
    W.rewrite_archives(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    again = W.read_archives(spark, str(tmp_path / "b")).select(cols).collect()
    assert Counter((*r[:5], bytes(r[5])) for r in again) == brute_warc(rows, 0)
    kept = W.read_records(spark, str(tmp_path / "b")).where("record_type = 'response'")
    assert kept.count() == kept.select("payload_digest").distinct().count()


def test_archives_keep_urls_and_one_header_line(spark, tmp_path):
    W.write_archives(spark.createDataFrame(pages(), PAGES), str(tmp_path / "a"))
    urls = {r["page_id"]: r["url"] for r in W.read_archives(spark, str(tmp_path / "a"), payload=False).collect()}
    assert urls[400] == "http://h/%0D%0AX-Page-Id: 5" and urls[403] is None and urls[0] == "http://h/0"


def test_archives_empty_and_cut_off(spark, tmp_path):
    W.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert W.read_archives(spark, str(tmp_path / "a")).count() == 0
    W.write_archives(spark.createDataFrame(pages()[:3], PAGES).coalesce(1), str(tmp_path / "b"))
    text = "".join(r[0] + W.END for r in spark.read.option("lineSep", W.END).text(str(tmp_path / "b")).collect())
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.txt").write_bytes(text[:-8].encode().replace(b"Content-Length: ", b"Content-Length: 9", 1))
    with pytest.raises(Exception, match="archive"):
        W.read_records(spark, str(tmp_path / "c")).count()


def test_base32_sha1(spark):
    texts = ["", "a", "é" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(W.base32_sha1(F.encode("t", "UTF-8"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
