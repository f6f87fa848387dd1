"""L: evaluation metrics as aggregates over (label, prediction[, score]) rows.

Classification metrics come from the confusion counts (a groupBy over
label x prediction, bounded by classes^2); AUC is the exact rank-sum with
tie-averaged ranks, computed over distinct scores with a bucketed running
sum (no single-task window over all rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.functions.ordering import running_sum, segment_running_sum


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """L4: (actual, predicted, n)."""
    return pred.groupBy(F.col(q(label)).alias("actual"), F.col(q(prediction)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: tp, support (actual count), predicted count -> precision, recall, F1 (0 on empty)."""
    cm = confusion_matrix(pred, label, prediction)
    actual = cm.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    tp = cm.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    t = actual.join(predicted, "cls", "full").join(tp, "cls", "left").fillna(0, subset=["support", "n_pred", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return t.withColumn("f1", f1)


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """L1: accuracy; precision / recall / F1 weighted by support (zero on empty)."""
    pc = per_class(pred, label, prediction)
    tot = F.sum("support").cast("double")
    return pc.agg(
        (F.sum("tp") / tot).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support plus macro and weighted averages."""
    pc = per_class(pred, label, prediction).where(F.col("support") > 0)
    rows = pc.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    tot = F.sum("support").cast("double")
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").cast("long").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
                      F.sum("support").cast("long").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def roc_auc_binary(pred: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """L2 (binary): exact AUC = P(score_pos > score_neg) + 0.5 P(tie), i.e. the tie-averaged rank sum."""
    is_pos = (F.col(q(label)) == F.lit(positive)).cast("long")
    g = pred.select(F.col(q(score)).cast("double").alias("_s"), is_pos.alias("_p")).where(F.col("_s").isNotNull())
    per = g.groupBy("_s").agg(F.sum("_p").alias("pos"), F.sum(1 - F.col("_p")).alias("neg"))
    per = running_sum(per, "_s", "neg", "neg_below", inclusive=False)
    agg = per.agg(F.sum(F.col("pos") * F.col("neg_below") + 0.5 * F.col("pos") * F.col("neg")).alias("num"),
                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.try_divide(F.col("num"), F.col("P") * F.col("N")).alias("auc"))


def roc_auc_ovr(pred: DataFrame, label: str, prob_col: str, classes: list) -> DataFrame:
    """L2 (multi-class): one-vs-rest AUC per class, weighted by class support. ``classes`` names the
    elements of the probability vector; all classes are ranked in one pass."""
    from pyspark.ml.functions import vector_to_array
    arr = pred.select(F.col(q(label)).cast("string").alias("_y"), F.posexplode(vector_to_array(F.col(q(prob_col)))).alias("_i", "score"))
    long = arr.select(F.element_at(F.array(*[F.lit(c).cast("string") for c in classes]), F.col("_i") + 1).alias("class"), "_y", "score")
    return roc_auc_ovr_long(long.withColumn("is_pos", F.col("_y") == F.col("class")))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """L3: RMSE, MAE, R^2 over the rows with a label (one aggregate; the total sum of squares is a
    variance, which does not cancel)."""
    y = F.col(q(label)).cast("double")
    e = y - F.col(q(prediction)).cast("double")
    sst = F.var_pop(y) * F.count(y)
    return pred.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                    (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"))


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Actual - predicted."""
    return pred.withColumn("residual", F.col(q(label)).cast("double") - F.col(q(prediction)).cast("double"))


def binary_report(pred: DataFrame, label: str = "label", prediction: str = "prediction", positive=1) -> DataFrame:
    """Accuracy, F1, precision, recall (positive class) and AUC on the hard labels."""
    y = (F.col(q(label)) == F.lit(positive)).cast("int")
    p = (F.col(q(prediction)) == F.lit(positive)).cast("int")
    base = pred.select(y.alias("_y"), p.alias("_p"))
    m = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_y") == F.col("_p"), 1).otherwise(0)).alias("ok"),
                 F.sum(F.col("_y") * F.col("_p")).alias("tp"), F.sum("_p").alias("pp"), F.sum("_y").alias("ap"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pp").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("ap").cast("double")), F.lit(0.0))
    out = m.select((F.col("ok") / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"))
    out = out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    auc = roc_auc_binary(base, "_y", "_p", positive=1)
    return _one_row_merge(out, auc)


def _one_row_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put the columns of two one-row aggregates side by side (equi-join on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def roc_auc_ovr_long(scores: DataFrame, cls: str = "class", score: str = "score", is_pos: str = "is_pos",
                     weighted: bool = True) -> DataFrame:
    """L2 (multi-class, one-vs-rest) from long scores ``(row, class, score, is_pos)``: exact
    tie-averaged AUC per class, then the support-weighted (or macro) mean. Work is one grouped
    pass per (class, score); the running sums run over ranges of (class, score), so a class with many
    distinct scores spans several tasks and the number of classes has no limit."""
    per = scores.groupBy(F.col(q(cls)).alias("_c"), F.col(q(score)).cast("double").alias("_s")).agg(
        F.sum(F.col(q(is_pos)).cast("long")).alias("pos"), F.sum(1 - F.col(q(is_pos)).cast("long")).alias("neg"))
    per = segment_running_sum(per, "_c", "_s", "neg", "nb", inclusive=False)
    auc = per.groupBy("_c").agg(
        F.try_divide(F.sum(F.col("pos") * F.col("nb") + 0.5 * F.col("pos") * F.col("neg")),
                     F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("support"))
    if weighted:
        return auc.agg((F.sum(F.col("auc") * F.col("support")) / F.sum(F.when(F.col("auc").isNotNull(),
                                                                                F.col("support")))).alias("auc"))
    return auc.agg(F.avg("auc").alias("auc"))
