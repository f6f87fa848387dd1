"""Benchmark passages in documents (DataFrame functions only).

A document is contaminated by a benchmark item if one of its windows, of the item's number of
words, has a weighted similarity of at least 80 % with the item: over five-word shingles, the sum
of the smaller counts by the sum of the larger counts.

1. Only windows that share shingles with the item can pass. The shingles of the items are matched
   against every shingle of every document; a (document, item) pair goes on only if the shared
   shingles weigh enough for 80 % (an exact bound), and with it the windows that reach the bound.
   Each shared shingle opens and closes a run of window starts; running sums over these events count
   them, so the work grows with the hits, not with hits times item length.
2. Such windows get a 64-bit SimHash of their words. Word hashes vote in 32 sums of two 32-bit
   lanes each, so a window's votes are plain sums, whatever its length.
3. Multi-index search: fingerprints are cut into ``BLOCKS`` blocks; two within ``RADIUS`` bits agree
   in some block up to ``RADIUS // BLOCKS`` bits. The items' blocks are expanded by all such
   differences, and windows join on the exact block. This misses no fingerprint within the radius.
4. Candidates within the radius are confirmed by the exact similarity.

A text or item with fewer than five words has all its words as one shingle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import save, small

SHINGLE = 5
PERCENT = 80
BLOCKS = 4
RADIUS = 15
_BITS = 64 // BLOCKS
#: One bit of each of the two lanes of a vote sum.
_LANES = 0x0000000100000001


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, by place; none if there are fewer words."""
    n = F.size(words)
    index = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _votes(word: Column) -> list[Column]:
    """32 longs; lane l of number j is bit j + 32 l of the word's hash."""
    h = F.xxhash64(word)
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES))).alias(f"v{j}") for j in range(32)]


def _fingerprint(n: Column) -> Column:
    """A bit is set if more than half of the n words vote for it."""
    out = None
    for j in range(32):
        for lane in range(2):
            votes = F.shiftrightunsigned(F.col(f"v{j}"), 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            bit = F.when(2 * votes > n, F.shiftleft(F.lit(1).cast("bigint"), j + 32 * lane)).otherwise(F.lit(0).cast("bigint"))
            out = bit if out is None else out.bitwiseOR(bit)
    return out


def _blocks(print_: Column) -> Column:
    mask = (1 << _BITS) - 1
    return F.array(*[F.shiftrightunsigned(print_, _BITS * b).bitwiseAND(F.lit(mask)) for b in range(BLOCKS)])


def _differences() -> list[int]:
    return [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(_BITS), k)]


def contaminated_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, shared, total, distance): the best window of each contaminated
    (document, item) pair; ``start`` counts words from 0, similarity is shared / total.

    Null, empty and word-less texts and items match nothing. Repeated items all report. Rows with a
    null doc_id or item_id report under null. Rows that repeat a doc_id are windows of one document
    id, each judged within its own text. Other columns are ignored; empty tables give an empty table.
    """
    items = benchmark.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0")
    items = save(items.groupBy("w").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("null_id"))
                 .select(F.xxhash64("w").alias("item"), "ids", "null_id", "w", F.size("w").alias("n")), "items")
    lengths = sorted({min(r[0], SHINGLE) for r in items.select(F.least("n", F.lit(SHINGLE))).distinct().collect()})  # 1 to 5
    parts = [items.where((F.col("n") >= k) if k == SHINGLE else (F.col("n") == k)).select("item", "n", F.explode(_shingles(F.col("w"), k)).alias("h")).withColumn("size", F.lit(k))
             for k in lengths]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start int, n_words int, shared bigint, total bigint, distance int")
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    grams = save(grams.groupBy("item", "n", "size", "h").agg(F.count("*").alias("weight")), "grams")
    known = small(grams.select("size", "h").distinct())

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("w"))
    places = None
    for k in lengths:
        p = texts.select("doc_id", "text_key", F.size("w").alias("m"), F.posexplode(_shingles(F.col("w"), k)).alias("at", "h")).withColumn("size", F.lit(k))
        places = p if places is None else places.unionByName(p)
    places = save(places.join(known, ["size", "h"]), "places")
    # an exact bound: at least PERCENT of the item's weight must be there
    seen = places.select("doc_id", "text_key", "size", "h").distinct().join(small(grams), ["size", "h"])
    total = grams.groupBy("item").agg(F.sum("weight").alias("all"))
    pairs = (seen.groupBy("doc_id", "text_key", "item").agg(F.sum("weight").alias("has")).join(small(total), "item")
             .where(f"100 * has >= {PERCENT} * all").select("doc_id", "text_key", "item", "all"))
    pairs = save(pairs, "hopeful")
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    on = ["doc_id", "text_key"]
    p, q = places.alias("p"), pairs.alias("q")
    hits = (p.join(q, [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in on]).select("p.*", "q.item", "q.all")
            .join(small(grams), ["item", "size", "h"]))
    hits = save(hits.distinct().select("doc_id", "text_key", "item", "n", "all", "m", "at", "size", "h", "weight"), "hits")
    # windows start where the item would, had each shared shingle the item's length behind or ahead
    pair = ["doc_id", "text_key", "item", "n", "all", "m"]
    first = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size") - F.col("n"), F.col("m") - F.col("n")))
    last = F.greatest(F.lit(0), F.least(F.col("at"), F.col("m") - F.col("n")))
    event = lambda at, by: F.struct(at.alias("start"), F.lit(by).alias("by"))
    events = hits.select(*pair, F.inline(F.array(event(first, 1), event(last + 1, -1)))).groupBy(*pair, "start").agg(F.sum("by").alias("by"))
    along = Window.partitionBy("doc_id", "text_key", "item").orderBy("start")  # one document's events
    runs = events.select(*pair, "start", F.sum("by").over(along).alias("hits"), F.lead("start").over(along).alias("until"))
    # shared <= hits, and total = own + all - shared, so a window at PERCENT has at least this many hits
    runs = (runs.withColumn("len", F.least("n", "m")).withColumn("own", F.greatest(F.col("len") - F.least("n", F.lit(SHINGLE)) + 1, F.lit(1)))
            .where(f"{100 + PERCENT} * hits >= {PERCENT} * (own + all)"))
    windows = save(runs.select(*pair, "len", "hits", F.explode(F.sequence("start", F.col("until") - 1)).alias("start")), "windows")
    texts_of = texts.join(small(windows.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct()),
                          F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    w, t = windows.alias("w"), texts_of.alias("t")
    spans = (w.join(t, [F.col(f"w.{k}").eqNullSafe(F.col(f"t.{k}")) for k in on])
             .select("w.*", F.slice("t.w", F.col("w.start") + 1, F.col("w.len")).alias("span")))
    spans = save(spans, "spans")
    key = ["doc_id", "text_key", "item", "start"]
    voted = spans.select("span").distinct().select("span", F.xxhash64("span").alias("span_key"))
    voted = voted.select("span_key", F.explode("span").alias("word")).groupBy("span_key").agg(*_votes(F.col("word")), F.count("*").alias("len"))
    prints = voted.select("span_key", _fingerprint(F.col("len")).alias("print"))
    item_votes = items.select("item", F.explode("w").alias("word")).groupBy("item").agg(*_votes(F.col("word")), F.count("*").alias("len"))
    item_prints = item_votes.select("item", _fingerprint(F.col("len")).alias("item_print"))
    variants = item_prints.select("item", "item_print", F.posexplode(_blocks(F.col("item_print"))).alias("b", "v"))
    variants = variants.select("item", "item_print", "b", F.explode(F.array(*[F.lit(d) for d in _differences()])).alias("d"), "v")
    index = save(variants.select("item", "item_print", "b", F.col("v").bitwiseXOR(F.col("d").cast("bigint")).alias("v")), "index")
    probe = prints.select("span_key", "print", F.posexplode(_blocks(F.col("print"))).alias("b", "v"))
    near = (probe.join(index, ["b", "v"]).select("span_key", "item", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("distance"))
            .where(F.col("distance") <= RADIUS).distinct())
    found = save(spans.withColumn("span_key", F.xxhash64("span")).join(near, ["span_key", "item"]), "near")
    # exact: the window's own shingle counts against the item's
    size = F.when(F.col("len") >= SHINGLE, SHINGLE).otherwise(F.col("len"))
    own = None
    for k in range(1, SHINGLE + 1):
        part = found.where(size == k).select(*key, "distance", "len", "all", F.explode(_shingles(F.col("span"), k)).alias("h"))
        own = part if own is None else own.unionByName(part)
    own = own.groupBy(*key, "distance", "len", "all", "h").agg(F.count("*").alias("count"))
    scored = (own.join(small(grams.select("item", "h", "weight")), ["item", "h"], "left").groupBy(*key, "distance", "len", "all")
              .agg(F.sum(F.least("count", F.coalesce("weight", F.lit(0)))).alias("shared"), F.sum("count").alias("mine")))
    scored = (scored.select(*key, "distance", "len", F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"),
                            (F.col("mine") + F.col("all") - F.coalesce("shared", F.lit(0))).cast("bigint").alias("total"))
              .where(f"100 * shared >= {PERCENT} * total"))
    order = F.struct(F.col("shared") / F.col("total"), -F.col("start"), F.struct("start", "len", "shared", "total", "distance").alias("w"))
    best = scored.groupBy("doc_id", "text_key", "item").agg(F.max(order).getField("w").alias("w"))
    named = items.select("item", F.explode(F.concat("ids", F.when(F.col("null_id"), F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))).alias("item_id"))
    return (best.join(named, "item").groupBy("doc_id", "item_id").agg(F.max("w").alias("w"))
            .select("doc_id", "item_id", F.col("w.start").alias("start"), F.col("w.len").alias("n_words"), "w.shared", "w.total", "w.distance"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns stay.

    Documents are told by doc_id; rows with a null doc_id go if any of them is contaminated.
    """
    fresh = "leaked"
    while fresh in {c.lower() for c in docs.columns}:
        fresh += "_"
    found = save(contaminated_windows(docs, benchmark).select(F.col("doc_id").alias(fresh)).distinct(), "leaked")
    return docs.join(small(found), F.col("doc_id").eqNullSafe(F.col(fresh)), "left_anti")
