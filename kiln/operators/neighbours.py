"""Nearest-neighbour operators.

Neighbours are exact and come from ``functions.nearest`` (pivot cells with triangle-inequality
bounds): a query meets only the blocks that can hold a nearer row, no pair rows are emitted, and
only pivots and one row per block pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import hash_unit
from kiln.functions.nearest import nearest_rows, vec_col
from kiln.operators.split import class_counts
from kiln.session import cut_lineage


def knn_candidates(query: DataFrame, ref: DataFrame, k: int, q_id: str, r_id: str, vec, label: str | None = None,
                   exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """The k nearest reference rows of every query row: ``(_qid, _tid, _dist, _tlabel, _rank)``; metric
    euclidean or manhattan."""
    q = query.select(F.col(q_id).alias("_qid"), vec_col(query, vec).alias("_qv"))
    lab = F.col(label).cast("double") if label else F.lit(0.0)
    r = ref.select(F.col(r_id).alias("_tid"), vec_col(ref, vec).alias("_tv"), lab.alias("_tlabel"))
    return nearest_rows(q, r, k, exclude_self, metric)


def knn_vote(query: DataFrame, ref: DataFrame, k: int, id_col: str, vec, label: str,
             weights: str = "uniform", exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """K4: majority vote of the k nearest labels (ties -> smallest label); ``distance`` weights 1/d."""
    cand = knn_candidates(query, ref, k, id_col, id_col, vec, label, exclude_self, metric)
    wexpr = F.lit(1.0) if weights == "uniform" else F.when(F.col("_dist") == 0, F.lit(1e300)).otherwise(
        1.0 / F.col("_dist"))
    votes = cand.groupBy("_qid", "_tlabel").agg(F.sum(wexpr).alias("_w"))
    w = Window.partitionBy("_qid").orderBy(F.desc("_w"), F.asc("_tlabel"))
    best = votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select(F.col("_qid").alias(id_col), F.col("_tlabel").alias("prediction"))


def knn_regress(query: DataFrame, ref: DataFrame, k: int, id_col: str, vec, target: str,
                exclude_self: bool = False, metric: str = "euclidean") -> DataFrame:
    """Mean target of the k nearest rows."""
    cand = knn_candidates(query, ref, k, id_col, id_col, vec, target, exclude_self, metric)
    return cand.groupBy(F.col("_qid").alias(id_col)).agg(F.avg("_tlabel").alias("prediction"))


def smote(df: DataFrame, target: str, features: list[str], id_col: str, k: int = 5, seed: int = 42,
          only_smallest: bool = False) -> DataFrame:
    """Oversample every minority class (or the smallest one alone) to the majority count by
    interpolating towards one of its k nearest same-class neighbours. Apply to training rows only.

    Synthetic rows are spread over the class rows round-robin in seeded-hash order; neighbour
    choice and gap come from seeded hashes, so the result is repeatable.
    """
    counts = class_counts(df, target)  # class count proven bounded first
    if not counts:
        return df
    major = max(counts.values())
    out = df.select(*features, target)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    chosen = sorted(counts.items(), key=lambda kv: str(kv[0]))
    if only_smallest:
        chosen = [min(chosen, key=lambda kv: kv[1])]
    for cls, n_c in chosen:
        need = major - n_c
        if need <= 0 or n_c < 2:
            continue
        kk = min(k, n_c - 1)
        sub = df.where(F.col(target) == F.lit(cls)).select(id_col, *features)
        cand = knn_candidates(sub, sub, kk, id_col, id_col, features, None, exclude_self=True)
        # position of each class row in hash order decides how many synthetic rows it seeds
        from kiln.functions.ordering import row_index
        ranked = row_index(sub.withColumn("_h", hash_unit([id_col], seed)), ["_h", id_col], "_pos")
        base, extra = divmod(need, n_c)
        reps = F.lit(base) + F.when(F.col("_pos") < extra, 1).otherwise(0)
        seeds = ranked.where(reps > 0).select(id_col, vec.alias("_x"),
                                              F.explode(F.sequence(F.lit(1), reps)).alias("_j"))
        seeds = seeds.withColumn("_nb", (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_j")), F.lit(kk)) + 1)
                                 .cast("int"))
        seeds = seeds.withColumn("_u", hash_unit([id_col, "_j"], seed + 1))
        nbv = cand.select(F.col("_qid").alias(id_col), F.col("_rank").alias("_nb"), F.col("_tid").alias("_nid"))
        ref = sub.select(F.col(id_col).alias("_nid"), vec.alias("_y"))
        syn = seeds.join(nbv, [id_col, "_nb"]).join(ref, "_nid")
        newv = F.zip_with("_x", "_y", lambda a, b: a + F.col("_u") * (b - a))
        syn = syn.select(newv.alias("_v"))
        syn = syn.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(features)],
                         F.lit(cls).cast(df.schema[target].dataType).alias(target))
        out = out.unionByName(syn)
    return out


def edited_nearest(df: DataFrame, target: str, features: list[str], id_col: str, k: int = 3) -> DataFrame:
    """I6 cleaning step (ENN): drop the rows, of any class, whose k neighbours do not all share their class."""
    cand = knn_candidates(df, df, k, id_col, id_col, features, target, exclude_self=True)
    lab = df.select(F.col(id_col).alias("_qid"), F.col(target).cast("double").alias("_own"))
    agree = cand.join(lab, "_qid").groupBy("_qid").agg(F.min((F.col("_tlabel") == F.col("_own")).cast("int")).alias("_ok"))
    bad = agree.where(F.col("_ok") == 0).select(F.col("_qid").alias(id_col))
    return df.join(bad, id_col, "left_anti")


def smote_enn(df: DataFrame, target: str, features: list[str], id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE of the smallest class, then edited nearest neighbours of all (on training rows only)."""
    res = smote(df, target, features, id_col, k, seed, only_smallest=True)
    res = res.withColumn(id_col, F.monotonically_increasing_id())
    res = cut_lineage(res)
    return edited_nearest(res, target, features, id_col).drop(id_col)
