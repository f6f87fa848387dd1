"""Rules over free text (problem statements, descriptions) and config advice.

B11 is pure column expressions (``contains`` chains) and runs over any text
column at scale. B12 needs Ratcliff-Obershelp similarity (``difflib``),
which Spark lacks: every distinct word is compared once with the names of the
columns and their parts (``mapInPandas`` over the vocabulary), and the words of a
text look their matches up by a join. Names, parts and scores of the texts are
column expressions. B13 is built on both.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.distinct import at_most
from kiln.functions.exprs import is_bool, is_numeric, is_string, q
from kiln.session import saved, ship_package

# Keyword lists that decide the learning and task type.
UNSUPERVISED_WORDS = ["cluster", "segmentation", "segment", "anomaly", "grouping", "pattern"]
SUPERVISED_WORDS = ["predict", "prediction", "classify", "classification", "regression", "forecast", "estimate",
                    "target", "label", "outcome"]
REGRESSION_WORDS = ["regression", "forecast", "estimate", "continuous", "numeric value", "real value"]
CLASSIFICATION_WORDS = ["class", "label", "churn", "fraud", "default", "approve", "reject", "classification"]
STRONG_SUPERVISED_WORDS = ["predict", "forecast", "estimate", "classify", "classification", "regression", "target",
                           "label", "outcome"]
WORD_PATTERN = r"[a-zA-Z_]+"
#: So many words that are like a column's name are broadcast.
BROADCAST_ROWS = 1_000_000


def _any_contains(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def learning_type_expr(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    sup = _any_contains(t, SUPERVISED_WORDS)
    uns = _any_contains(t, UNSUPERVISED_WORDS)
    return F.when(uns & ~sup, "unsupervised").when(sup, "supervised").otherwise("unsupervised")


def task_type_expr(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    reg = _any_contains(t, REGRESSION_WORDS)
    cls = _any_contains(t, CLASSIFICATION_WORDS)
    return F.when(reg & ~cls, "regression").when(cls, "classification").otherwise("classification")


def classify_problem_text(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Learning type and task type of every text (whole texts, JVM-side)."""
    t = F.col(q(text_col))
    return df.select(id_col, learning_type_expr(t).alias("learning_type"), task_type_expr(t).alias("task_type"))


ALPHABET = "abcdefghijklmnopqrstuvwxyz_"
_CODE = {ch: i for i, ch in enumerate(ALPHABET)}


def _counts(word: str) -> np.ndarray:
    v = np.zeros(len(ALPHABET), dtype=np.int32)
    for ch in word:
        v[_CODE[ch]] += 1
    return v


class _Words:
    """Words with character counts, for vectorised difflib pre-filters."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lens = np.array([len(w) for w in words], dtype=np.float64)
        self.counts = np.stack([_counts(w) for w in words]) if words else np.zeros((0, len(ALPHABET)), np.int32)

    def near(self, target: str, cutoff: float) -> list[int]:
        """Places of the words whose difflib ratio against ``target`` is at least ``cutoff``.

        The real-quick (length) and quick (character multiset) upper bounds of the ratio are
        evaluated for all words at once; SequenceMatcher runs only on the survivors. What is in
        ``target`` besides the alphabet of words matches nothing.
        """
        if not self.words:
            return []
        lt = float(len(target))
        tot = self.lens + lt
        idx = np.flatnonzero(2.0 * np.minimum(self.lens, lt) / tot >= cutoff)
        letters = _counts("".join(ch for ch in target if ch in _CODE))
        inter = np.minimum(self.counts[idx], letters[None, :]).sum(axis=1)
        idx = idx[2.0 * inter / tot[idx] >= cutoff]
        return [int(i) for i in idx if difflib.SequenceMatcher(None, self.words[i], target).ratio() >= cutoff]


SAME, LIKE_NAME, LIKE_PART = "same", "like name", "like part"


def _clues(columns: list[str]) -> list[tuple[str, str]]:
    """What a word can be to the columns: equal to a part (3 letters or more), like a whole name, like
    a part (4 letters or more)."""
    found = dict.fromkeys((LIKE_NAME, c.lower()) for c in columns)
    for part in (t for c in columns for t in re.findall(WORD_PATTERN, c.lower())):
        if len(part) >= 3:
            found[(SAME, part)] = None
        if len(part) >= 4:
            found[(LIKE_PART, part)] = None
    return list(found)


def _matches(clues: list[tuple[str, str]]):
    """From batches of distinct words to (word, c): the clues that a word is."""
    def work(batches):
        for batch in batches:
            texts = batch["word"].tolist()
            words, place, pairs = _Words(texts), {w: i for i, w in enumerate(texts)}, []
            for n, (kind, target) in enumerate(clues):
                if kind == SAME:
                    hits = [place[target]] if target in place else []
                else:
                    hits = words.near(target, 0.75 if kind == LIKE_NAME else 0.8)
                pairs += [(texts[i], n) for i in hits]
            yield pd.DataFrame(pairs, columns=["word", "c"])
    return work


def score_target_columns(text_df: DataFrame, text_col: str, id_col: str, columns: list[str],
                         carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row of ``text_df`` the column its text points at (``target``; missing when none), its
    ``score``, the other columns with a score (``alternatives``, best first) and ``confidence``: the
    score's share of the two best scores (0 to 1, 0 when none).

    A column scores 6 when its name is in the text, 2 for each part that is a word of it, 3 when a word is
    like the name, 1.5 for each part that a word is like; equal scores keep column order. Ids may be
    missing or repeat. ``carry`` adds columns computed from the text (``_t``: lower case, missing as empty).
    """
    names = [c.lower() for c in columns]
    base = text_df.select(q(id_col), F.lower(F.coalesce(F.col(q(text_col)), F.lit(""))).alias("_t"))
    flat = base.select(q(id_col), F.md5("_t").alias("_key"), *[c.alias(n) for n, c in (carry or {}).items()],
                       F.array(*[F.contains("_t", F.lit(c)) for c in names]).alias("_in"))
    kept = [F.col(q(id_col)), *[F.col(n) for n in (carry or {})]]
    if not names:
        return flat.select(*kept, F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("alternatives"))
    ship_package(text_df.sparkSession)
    clues = _clues(columns)
    number = {c: i for i, c in enumerate(clues)}
    words = base.select(F.md5("_t").alias("_k"), F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(f"({WORD_PATTERN})")))).alias("word"))
    known = saved(words.select("word").distinct(), "vocabulary").mapInPandas(_matches(clues), "word string, c int")
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # then no word of a text is shuffled
        known = F.broadcast(known)
    seen = words.join(known, "word").groupBy("_k").agg(F.collect_set("c").alias("_seen"))
    rows = flat.join(seen, F.col("_key") == F.col("_k"), "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<int>")))

    def points(clue: tuple[str, str], worth: float) -> Column:
        return F.when(F.array_contains("_seen", number[clue]), worth).otherwise(0.0) if clue in number else F.lit(0.0)

    ranked = []
    for i, name in enumerate(names):
        score = F.when(F.col("_in")[i], 6.0).otherwise(0.0) + points((LIKE_NAME, name), 3.0)
        for part in re.findall(WORD_PATTERN, name):
            score = score + points((SAME, part), 2.0) + points((LIKE_PART, part), 1.5)
        ranked.append(F.struct((-score).alias("s"), F.lit(i).alias("i"), F.lit(columns[i]).alias("name")))
    rows = rows.withColumn("_best", F.array_sort(F.filter(F.array(*ranked), lambda r: r["s"] < 0)))
    best, second = (F.negative(F.coalesce(F.get("_best", F.lit(i))["s"], F.lit(0.0))) for i in (0, 1))
    return rows.select(*kept, F.get("_best", F.lit(0))["name"].alias("target"), F.abs(best).alias("score"),
                       F.coalesce(F.try_divide(best, best + second), F.lit(0.0)).alias("confidence"),
                       F.transform(F.slice("_best", 2, max(1, len(names))), lambda r: r["name"]).alias("alternatives"))


def resolve_target(df: DataFrame, text: str = "", hint: str | None = None) -> dict:
    """B13 for a table and one problem text: the row of ``resolve_target_texts``."""
    one = df.sparkSession.createDataFrame([(0, text or "")], "id int, text string")
    found = resolve_target_texts(one, "text", "id", df, hint).first().asDict()
    found.pop("id")
    return found


def recommend_config(df: DataFrame, target: str | None = None) -> DataFrame:
    """The decision rules, computed from one aggregate instead of a remote model.

    mean if the median |skew| of numeric columns is < 0.5 else median; IQR below 1,000 rows
    else z-score; cap when IQR outliers are < 5 % of rows else remove; one-hot when every text
    column has < 10 values else label; test size 0.2 when the target's minority/majority ratio
    is >= 0.6 (or no target) else 0.3.
    """
    from statistics import median

    from kiln.functions.exprs import skew_sample
    from kiln.operators.outliers import count_outliers, iqr_bounds
    nums = [c for c in df.columns if is_numeric(df.schema[c].dataType) and c != target]
    texts = [c for c in df.columns if (is_string(df.schema[c].dataType) or is_bool(df.schema[c].dataType))
             and c != target]
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[skew_sample(F.col(q(c)).cast("double")).alias(c) for c in nums]).first()
    n = int(r["_n"])
    skews = [abs(r[c]) for c in nums if r[c] is not None]
    med_skew = median(skews) if skews else 0.0
    b = iqr_bounds(df, nums)
    outs = count_outliers(df, b)
    out_share = (max(outs.values()) / n) if outs and n else 0.0
    few_levels = None not in at_most(df, dict.fromkeys(texts, 9)).values()
    ratio = None
    if target:
        # smallest / largest class count in one row (a continuous target has one group per value)
        mm = df.groupBy(q(target)).count().agg(F.min("count").alias("lo"), F.max("count").alias("hi")).first()
        ratio = mm["lo"] / mm["hi"] if mm["hi"] else None
    rows = [(
        "Fill — mean" if med_skew < 0.5 else "Fill — median",
        "IQR" if n < 1000 else "Z-score",
        "Cap (clip)" if out_share < 0.05 else "Remove rows",
        "One-Hot Encoding" if few_levels else "Label Encoding",
        0.2 if ratio is None or ratio >= 0.6 else 0.3,
        float(med_skew), float(out_share))]
    return df.sparkSession.createDataFrame(
        rows, "missing_strategy string, outlier_method string, outlier_action string, encoding_method string, "
              "test_size double, median_abs_skew double, max_outlier_share double")


def resolve_target_texts(text_df: DataFrame, text_col: str, id_col: str, table: DataFrame,
                         hint: str | None = None) -> DataFrame:
    """B13 for every text of ``text_df`` against the columns of ``table``: learning type, task type, target,
    confidence and alternatives.

    A target is the valid ``hint``, else the best-scoring column, else a column named as a whole word, else
    the first candidate (text / bool, then numeric with few values). Strong supervised words or a scored column
    make the task supervised; an unsupervised one has no target and no alternatives. Confidence is 1 for a hint,
    that of the score for a scored column, 0 else.
    """
    from kiln.operators.profile import candidate_targets
    cols = table.columns
    t = F.col("_t")
    whole = F.lit(None).cast("string")
    for c in reversed(cols):
        whole = F.when(t.rlike(r"\b" + re.escape(c.lower()) + r"\b"), F.lit(c)).otherwise(whole)
    rows = score_target_columns(text_df, text_col, id_col, cols, {
        "_said": _any_contains(t, STRONG_SUPERVISED_WORDS) | _any_contains(t, SUPERVISED_WORDS), "_task": task_type_expr(t), "_whole": whole})
    cands = candidate_targets(table, variant="auto") if cols else []
    given = F.lit(hint if hint in cols else None).cast("string")
    chosen = F.coalesce(given, F.col("target"), F.col("_whole"), F.lit(cands[0] if cands else None).cast("string"))
    # problem type of every column the target can be
    n = table.count()
    nums = [c for c in cols if is_numeric(table.schema[c].dataType)]
    wide = [c for c, u in at_most(table, dict.fromkeys(nums, max(15, int(0.05 * n)))).items() if u is None]
    supervised = F.col("target").isNotNull() | F.col("_said")
    task = (F.when(~supervised, "unsupervised").when(chosen.isNull(), F.col("_task"))
            .when(chosen.isin(*wide) if wide else F.lit(False), "regression").otherwise("classification"))
    none = F.array().cast("array<string>")
    return rows.select(q(id_col), F.when(supervised, "supervised").otherwise("unsupervised").alias("learning_type"),
                       task.alias("task_type"), F.when(supervised, chosen).alias("target"),
                       F.when(~supervised, 0.0).when(given.isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
                       F.when(supervised, F.filter(F.concat(F.when(F.col("target").isNull(), none).otherwise(F.array("target")), "alternatives"),
                                                   lambda c: c != F.coalesce(chosen, F.lit("")))).otherwise(none).alias("alternatives"))
