"""I: exact-size repeatable splits, folds, class balance.

Rows are ordered by md5('<seed>|<key>'), text that DuckDB and any other
engine produce identically. The test set is the first ceil(n * t) rows of
that order (per class for the stratified split). Instead of ranking all
rows with a global window (one task), the cut is found with the exact
distributed selector: the k-th smallest 52-bit hash prefix per class, with
the rare ties on the prefix settled by the full digest. Many classes are
ranked in ranges of (class, digest) instead, as folds are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import hash_unit, q, seeded_hash
from kiln.functions.ordering import row_index, segment_index
from kiln.functions.selection import global_kth, kth_many, order_statistics
from kiln.session import cut_lineage

RESAMPLE_RATIO = 0.60
MAX_CLASSES = 10_000  # resampling collects one row per class; more is not a class column
LITERAL_CLASSES = 64  # cuts of so many classes are literals in the plan


def class_counts(df: DataFrame, stratify: str) -> dict:
    """``{class: rows}`` after one aggregate proves the class count is at most ``MAX_CLASSES``."""
    g = df.groupBy(q(stratify)).agg(F.count(F.lit(1)).alias("n"))
    if g.agg(F.count(F.lit(1)).alias("k")).first()["k"] > MAX_CLASSES:
        raise ValueError(f"{stratify} has more than {MAX_CLASSES} classes; not a class column")
    return {r[0]: int(r["n"]) for r in g.collect()}


def _cut(df: DataFrame, k_df: DataFrame) -> DataFrame:
    """The hash of the k-th row (k from the one row of ``k_df``, at least 1) and the tie cut: one row."""
    def targets(counts: DataFrame) -> DataFrame:
        t = _attach(counts, k_df)
        return t.where(F.col("_k") >= 1).select(F.lit(0).alias("tid"), (F.col("_k") - 1).alias("k"))

    stats = order_statistics(df, [], "_h", targets)
    thr = _attach(stats.select(F.col("value").alias("_thr"), F.col("below").alias("_lt"), F.col("eq").alias("_eq")), k_df)
    row = thr.first()
    schema = thr.select("_thr").schema.add("_cut", "string")
    if row is None or row["_k"] - row["_lt"] == row["_eq"]:
        # the k-th hash prefix is not shared across the cut: take every row up to it
        return df.sparkSession.createDataFrame([] if row is None else [(row["_thr"], None)], schema)
    # rows sharing the threshold prefix: a handful, ranked by the full digest
    ties = _attach(df, thr).where(F.col("_h") == F.col("_thr"))
    ties = ties.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_md5")))
    return _attach(thr.select("_thr"), ties.where(F.col("_rn") == F.col("_k") - F.col("_lt")).select(F.col("_md5").alias("_cut")), how="left")


def _attach(df: DataFrame, row: DataFrame, how: str = "inner") -> DataFrame:
    """Put the columns of a one-row table beside every row."""
    return (df.withColumn("_g", F.lit(0))
            .join(F.broadcast(row.withColumn("_g", F.lit(0))), "_g", how).drop("_g"))


def _allocate(counts: dict, n_test: int) -> dict:
    """Largest-remainder split of ``n_test`` over classes (ties: larger remainder, then class value)."""
    n = sum(counts.values())
    base = {c: (v * n_test) // n for c, v in counts.items()}
    rest = n_test - sum(base.values())
    order = sorted(counts, key=lambda c: (-((counts[c] * n_test) % n), str(c)))
    for c in order[:rest]:
        base[c] += 1
    return base


def _allocation(counts: DataFrame, n: int, n_test: int) -> DataFrame:
    """``_allocate`` over a class table (``_c``, ``_n``) of any length: (``_c``, ``_k``)."""
    part = F.col("_n").cast("decimal(19,0)") * F.lit(n_test).cast("decimal(19,0)")
    a = cut_lineage(counts.withColumn("_w", part).select(
        "_c", F.expr(f"_w div {n}BD").alias("_base"), F.expr(f"-(_w % {n}BD)").alias("_rem"), F.col("_c").cast("string").alias("_text")))
    rest = n_test - int(a.agg(F.sum("_base")).first()[0])
    return row_index(a, ["_rem", "_text"], "_rr").select("_c", (F.col("_base") + (F.col("_rr") < rest).cast("long")).alias("_k"))


def split_flags(df: DataFrame, key_cols: list[str], test: float = 0.2, seed: int = 42,
                stratify: str | None = None) -> DataFrame:
    """``df`` with a boolean ``is_test`` column (exact sizes).

    Up to ``LITERAL_CLASSES`` classes the cuts are literals found by selection. With more, rows are
    ranked within their class in ranges of (class, digest); the number of classes has no limit.
    """
    spark = df.sparkSession
    h = df.withColumn("_md5", seeded_hash(key_cols, seed)).withColumn("_h", hash_unit(key_cols, seed))
    if stratify:
        cls = F.col(q(stratify))
        table = df.groupBy(cls.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
        size = table.agg(F.count(F.lit(1)).alias("classes"), F.min("_n").alias("least"), F.sum("_n").alias("n")).first()
        if not size["classes"] or size["least"] < 2:
            return split_flags(df, key_cols, test, seed, None)
        n_test = math.ceil(size["n"] * test)
        if size["classes"] <= LITERAL_CLASSES:
            counts = {r["_c"]: int(r["_n"]) for r in table.collect()}
            picks = [(c, k) for c, k in sorted(_allocate(counts, n_test).items(), key=lambda kv: str(kv[0])) if k >= 1]
            fast = kth_many(h, "_h", [(cls.eqNullSafe(F.lit(c)), k - 1, k / counts[c]) for c, k in picks]) \
                if picks else []
            if fast is not None and all(k - lt == eq for (_, k), (_, lt, eq) in zip(picks, fast)):
                is_test = F.lit(False)
                for (c, _), (thr, _, _) in zip(picks, fast):
                    is_test = F.when(cls.eqNullSafe(F.lit(c)), F.col("_h") <= F.lit(thr)).otherwise(is_test)
                return h.withColumn("is_test", is_test).drop("_h", "_md5")
        ranked = segment_index(h, stratify, ["_md5"], "_i")
        j = ranked.join(_allocation(table, int(size["n"]), n_test), cls.eqNullSafe(F.col("_c")), "left")
        return j.withColumn("is_test", F.col("_i") < F.col("_k")).drop("_h", "_md5", "_i", "_c", "_k")
    n = df.count()
    k = int(math.ceil(n * test))
    fast = global_kth(h, "_h", k - 1, k / n) if 0 < k <= n else None
    if fast is not None and k - fast[1] == fast[2]:
        # the k-th hash prefix is not shared across the cut: every row up to it is test
        return h.withColumn("is_test", F.col("_h") <= F.lit(fast[0])).drop("_h", "_md5")
    j = _attach(h, _cut(h, spark.createDataFrame([(k,)], "_k long")), how="left")
    is_test = (F.col("_h") < F.col("_thr")) | ((F.col("_h") == F.col("_thr")) &
                                              (F.col("_cut").isNull() | (F.col("_md5") <= F.col("_cut"))))
    return j.withColumn("is_test", F.coalesce(is_test, F.lit(False))).drop("_h", "_md5", "_thr", "_cut")


def split_random(df: DataFrame, key_cols: list[str], test: float = 0.2, seed: int = 42):
    """(train, test). The flagged frame is checkpointed once: both splits and every later
    fit read it instead of re-running the selection."""
    f = cut_lineage(split_flags(df, key_cols, test, seed))
    return f.where(~F.col("is_test")).drop("is_test"), f.where("is_test").drop("is_test")


def split_stratified(df: DataFrame, target: str, key_cols: list[str], test: float = 0.2, seed: int = 42):
    """Keeps class shares when every class has >= 2 rows, else falls back to I1."""
    f = cut_lineage(split_flags(df, key_cols, test, seed, stratify=target))
    return f.where(~F.col("is_test")).drop("is_test"), f.where("is_test").drop("is_test")


def fold_count(df: DataFrame, k: int, target: str | None = None) -> int:
    """k = min(requested, rows, smallest class); 0 when fewer than 2."""
    n = df.count()
    kk = min(k, n)
    if target is not None:
        r = df.groupBy(target).count().agg(F.min("count").alias("m")).first()["m"]
        kk = min(kk, int(r or 0))
    return kk if kk >= 2 else 0


def assign_folds(df: DataFrame, k: int, key_cols: list[str], stratify: str | None = None,
                 seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """fold = (rank within class in hash order) mod k, so every fold gets a share of
    every class. Ranks come from distributed positions (no window per class, no class limit)."""
    h = df.withColumn("_md5", seeded_hash(key_cols, seed))
    idx = segment_index(h, stratify, ["_md5"], "_i") if stratify else row_index(h, ["_md5"], "_i")
    return cut_lineage(idx.withColumn(fold_col, (F.col("_i") % k).cast("int")).drop("_md5", "_i"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """I4: class counts, min/max ratio and whether to resample (ratio < 0.60 and min >= 2)."""
    counts = df.groupBy(F.col(q(target)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # only the min / max summary comes to the driver; the per-class rows stay distributed
    s = counts.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n")).first()
    ratio = (s["min_n"] / s["max_n"]) if s["max_n"] else None
    resample = ratio is not None and ratio < RESAMPLE_RATIO and s["min_n"] >= 2
    return counts.select(F.col("class").cast("string").alias("class"), "n",
                         F.lit(ratio).cast("double").alias("ratio"), F.lit(bool(resample)).alias("resample"))
