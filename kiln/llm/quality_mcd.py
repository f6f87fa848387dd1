"""Quality rules by robust multivariate outliers (DataFrame functions only).

Each document gets five text statistics. A fixed base rule rejects tiny and repetitive texts. The
rest is judged against its language and source: a minimum-covariance-determinant estimate of the
transformed statistics (half of the group with the smallest covariance determinant, found by
C-steps from coordinatewise medians) gives centre and scatter; a document is rejected when its
squared Mahalanobis distance exceeds ``CUT`` times the group's median distance.

Group statistics come from counts over fixed logarithmic bins and from moments, both partially
aggregated, so a group with a third of all rows is no hot task. Groups with fewer than
``MIN_GROUP`` judged documents take the estimate of their language, or else of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kiln.llm.common import save, small

#: Share of a group that the scatter is estimated from.
HALF = 0.5
#: Smallest standard deviation of a transformed statistic: a statistic that is 0 in most texts has none.
FLOOR = (0.35, 0.05, 0.12, 0.12, 0.12)
#: Largest squared distance, in multiples of the group's median one.
CUT = 60.0
MIN_GROUP = 50
TOLERANCE = 1e-3

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_DIM = len(FLOOR)
_X = [f"x{i}" for i in range(_DIM)]
#: Resolution of the distance bins: 16 bins for each doubling.
_BINS = 16


def _fresh(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def with_stats(docs: DataFrame, name: str = "_stats") -> DataFrame:
    """``docs`` with a struct column of the statistics of ``text``; no shuffle, no other column touched."""
    words, grams, places, spots = (_fresh(docs, f"{name}_{k}") for k in ("words", "grams", "places", "spots"))
    base = docs.columns
    text = F.coalesce("text", F.lit(""))
    word_list = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    step = docs.select("*", word_list.alias(words))
    n = F.size(words)
    index = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    step = step.select("*", F.transform(index, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))).alias(grams))
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    # windows as (hash, place) in order, only where some window is found twice
    step = step.select("*", F.when(repeats, F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias(places))
    twin = lambda x, i: (x["h"] == F.get(places, i + 1)["h"]) | (x["h"] == F.get(places, i - 1)["h"])
    found = F.filter(places, lambda x, i: F.coalesce(twin(x, i), F.lit(False)) | F.coalesce(x["h"] == F.get(places, i + 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(places, i - 1)["h"], F.lit(False)))
    step = step.select("*", F.sort_array(F.transform(found, lambda x: x["i"])).alias(spots))
    covered = F.transform(spots, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - x, F.lit(3))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stats = F.struct(
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return step.select(*base, stats.alias(name))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def transformed(s: Column) -> list[Column]:
    """The statistics on scales on which clean texts of one kind are close to symmetric."""
    n = F.greatest(s["n_words"], F.lit(1))
    share = lambda c: F.log1p(10.0 * c / n)
    return [F.log(n.cast("double")), F.log(F.greatest(s["word_chars"], F.lit(1)) / n), share(s["n_symbols"]),
            share(5 * s["n_dup_lines"]), share(s["n_repeat_words"])]


def _group(lang: str, source: str) -> tuple[Column, Column]:
    """Keys that tell null from any text."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return key(lang), F.concat_ws("\x1f", key(lang), key(source))


def _quantile_edge(rows: DataFrame, value: Column, share: float, name: str) -> DataFrame:
    """Per group g: the upper edge of the first logarithmic bin with ``share`` of the rows at or below it."""
    bins = rows.groupBy("g", F.floor(F.log2(F.greatest(value, F.lit(1e-9))) * _BINS).alias("bin")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy("g").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    every = F.sum("m").over(W.partitionBy("g"))
    return (bins.select("g", "bin", upto.alias("upto"), every.alias("every")).where(F.col("upto") >= share * F.col("every"))
            .groupBy("g").agg(F.pow(F.lit(2.0), (F.min("bin") + 1) / _BINS).alias(name)))


def _median_bins(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Per group: medians of the columns, to 1/256, from one grouped count."""
    long = rows.select("g", F.posexplode(F.array(*columns)).alias("k", "v"))
    bins = long.groupBy("g", "k", F.round(F.col("v") * 256).alias("bin")).agg(F.count("*").alias("m"))
    w = W.partitionBy("g", "k")
    upto = F.sum("m").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    mid = (bins.select("g", "k", "bin", upto.alias("upto"), F.sum("m").over(w).alias("every")).where("upto >= 0.5 * every")
           .groupBy("g", "k").agg((F.min("bin") / 256).alias("v")))
    return mid.groupBy("g").agg(*[F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"{name}{i}") for i in range(len(columns))])


def _factor(table: DataFrame) -> DataFrame:
    """Group table with moments m_i and c_i_j to centre m_i and the rows l_i_j of the Cholesky factor."""
    t = table
    for i in range(_DIM):
        for j in range(i + 1):
            c = F.col(f"c_{j}_{i}")
            for k in range(j):
                c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                t = t.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(c, F.lit(0.0)) + FLOOR[i] ** 2))
            else:
                t = t.withColumn(f"l_{i}_{j}", c / F.col(f"l_{j}_{j}"))
    return t


def _distance(rows: DataFrame, name: str) -> DataFrame:
    """Squared Mahalanobis distance, by forward substitution with the group's factor."""
    t = rows
    for i in range(_DIM):
        y = F.col(_X[i]) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        t = t.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, _DIM)), F.col("y_0") * F.col("y_0"))
    return t.withColumn(name, total)


_FACTOR = [f"m_{i}" for i in range(_DIM)] + [f"l_{i}_{j}" for i in range(_DIM) for j in range(i + 1)]


def fit(stats: DataFrame) -> DataFrame:
    """Estimates per group key ``g`` from (g, x0..): m_i, l_i_j, and ``scale``, the median squared distance."""
    medians = _median_bins(stats, _X, "m_")
    spread = stats.join(small(medians), "g").select("g", *[F.abs(F.col(_X[i]) - F.col(f"m_{i}")).alias(_X[i]) for i in range(_DIM)])
    mads = _median_bins(spread, _X, "s_")
    table = medians.join(mads, "g")
    for i in range(_DIM):
        for j in range(i + 1):
            table = table.withColumn(f"l_{i}_{j}", F.sqrt(F.pow(1.4826 * F.col(f"s_{i}"), 2) + FLOOR[i] ** 2) if i == j else F.lit(0.0))
    table = save(table.select("g", *_FACTOR), "start")
    before = None
    while True:
        far = _distance(stats.join(small(table), "g"), "d")
        edge = save(_quantile_edge(far, F.col("d"), HALF, "edge"), "edge")
        near = far.join(small(edge), "g").where("d <= edge")
        moments = near.groupBy("g").agg(*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(_X)],
                                        *[F.covar_pop(_X[j], _X[i]).alias(f"c_{j}_{i}") for i in range(_DIM) for j in range(i + 1)])
        table = save(_factor(moments).select("g", *_FACTOR), "step")
        volume = sum(F.log(F.col(f"l_{i}_{i}")) for i in range(_DIM))
        now = table.agg(F.avg(volume)).first()[0]
        if now is None or before is not None and before - now < TOLERANCE:
            break
        before = now
    far = _distance(stats.join(small(table), "g"), "d")
    return save(table.join(_quantile_edge(far, F.col("d"), 0.5, "scale"), "g"), "estimates")


def estimates(stats: DataFrame) -> DataFrame:
    """Estimates for every (lang, source) key of (lang, source, s): the group's own, or its language's,
    or those of all documents, whichever first has ``MIN_GROUP`` documents that pass the base rule."""
    one, two = _group("lang", "source")
    rows = stats.where(~base_failed(F.col("s"))).select(one.alias("one"), two.alias("two"), *[c.alias(x) for c, x in zip(transformed(F.col("s")), _X, strict=True)])
    sizes = save(rows.groupBy("one", "two").agg(F.count("*").alias("m")), "sizes")
    langs = sizes.groupBy("one").agg(F.sum("m").alias("m1"))
    level = sizes.join(langs, "one").select("two", F.when(F.col("m") >= MIN_GROUP, F.concat(F.lit("2"), "two"))
                                            .when(F.col("m1") >= MIN_GROUP, F.concat(F.lit("1"), "one")).otherwise("0").alias("key"))
    level = save(level, "level")
    wants = {r[0] for r in level.select(F.substring("key", 1, 1)).distinct().collect()}  # at most "0", "1", "2"
    parts = [rows.join(small(level.where("key like '2%'")), "two").select(F.col("key").alias("g"), *_X)] if "2" in wants else []
    if "1" in wants:
        parts.append(rows.join(small(level.where("key like '1%'").select(F.substring("key", 2, 1 << 30).alias("one")).distinct()), "one")
                     .select(F.concat(F.lit("1"), "one").alias("g"), *_X))
    if "0" in wants or not parts:
        parts.append(rows.select(F.lit("0").alias("g"), *_X))
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    return save(level.join(fit(save(pool, "vectors")).withColumnRenamed("g", "key"), "key"), "fitted").drop("key")


def judge(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (lang, source, s and any others) with base_failed, distance (in multiples of the group's
    median) and kept. A text that passes the base rule always has an estimate."""
    own = rows.columns
    _, two = _group("lang", "source")
    t = rows.select("*", two.alias("two"), *[c.alias(x) for c, x in zip(transformed(F.col("s")), _X, strict=True)])
    t = _distance(t.join(small(table), "two", "left"), "d")
    failed = base_failed(F.col("s"))
    distance = F.col("d") / F.col("scale")
    return t.select(*own, failed.alias("base_failed"), distance.alias("distance"),
                    (~failed & F.coalesce(distance <= CUT, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for
    each row of ``docs`` (doc_id, text, lang, source).

    A null or empty text has no words and fails the base rule. Null languages and sources are groups
    of their own. Repeated rows are judged one by one, alike. An empty table gives an empty table.
    """
    rows = with_stats(docs.select("doc_id", "text", "lang", "source"), "s").drop("text")
    rows = save(rows, "stats")
    done = judge(rows, estimates(rows))
    return done.select("doc_id", *[F.col("s")[k].alias(k) for k in STATS], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns stay as they are, whatever their names."""
    rows = save(with_stats(docs.select("text", "lang", "source"), "s").drop("text"), "stats")
    table = estimates(rows)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "text", "lang", "source")
    # each explode of one value keeps the optimiser from copying what is below it into the filter
    stats = with_stats(packed, "t").select("row", "lang", "source", F.explode(F.array("t")).alias("s"))
    done = judge(stats, table).select("row", F.explode(F.array("kept")).alias("stays"))
    return done.where("stays").select(*[F.col("row")[c].alias(c) for c in names])
