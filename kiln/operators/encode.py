"""G: feature engineering and encoding.

Each encoder is a fit (one frequency aggregate, bounded result) and a
transform built as a single ``select`` (never a chain of ``withColumn``, so
wide one-hot projections stay inside one codegen stage).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.distinct import at_most
from kiln.functions.exprs import (finite, is_bool, is_numeric, is_string, is_temporal, q, signed_log,
                                  skew_sample)
from kiln.functions.lookup import MAP_LITERAL_MAX, Lookup
from kiln.functions.ordering import row_index

# Text accepted as boolean, and its 0/1 meaning.
BOOL_LIKE = {"true": 1, "false": 0, "yes": 1, "no": 0, "y": 1, "n": 0, "t": 1, "f": 0, "1": 1, "0": 0}
NAN_TEXT = "nan"
SKEW_THRESHOLD = 0.75
MAX_ONEHOT = 10


def skewed_columns(df: DataFrame, cols: list[str], thr: float = SKEW_THRESHOLD) -> DataFrame:
    """G1: numeric columns with |corrected skew| > thr, most skewed first."""
    parts = [F.struct(F.lit(c).alias("column_name"), skew_sample(finite(F.col(q(c)))).alias("skew")) for c in cols]
    long = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return long.where(F.abs("skew") > thr).orderBy(F.desc(F.abs("skew")))


def add_signed_log(df: DataFrame, cols: list[str], suffix: str = "_log") -> DataFrame:
    """Adds ``<c>_log = sign(c) * log1p(|c|)``, original kept."""
    return df.select("*", *[signed_log(finite(F.col(q(c)))).alias(c + suffix) for c in cols])


def bool_to_int(df: DataFrame) -> DataFrame:
    """Boolean columns -> 0/1."""
    return df.select(*[F.col(q(c)).cast("int").alias(c) if is_bool(df.schema[c].dataType) else F.col(q(c))
                       for c in df.columns])


def _text(c: str) -> Column:
    return F.col(q(c)).cast("string")


def _codes_from_order(table: DataFrame, order: str, value_type: str = "string") -> Lookup:
    """Codes 0..n-1 of ``table._v`` by ascending ``order``; distributed index when large."""
    head = table.orderBy(order, "_v").limit(MAP_LITERAL_MAX + 1).collect()
    if len(head) <= MAP_LITERAL_MAX:
        return Lookup("string", "double", pairs=[(r["_v"], float(i)) for i, r in enumerate(head)])
    idx = row_index(table, [order, "_v"], "_code")
    return Lookup.from_table(idx.select(F.col("_v").alias("_k"), F.col("_code").cast("double").alias("_val")))


def fit_label_first(df: DataFrame, col: str, order_by: str) -> Lookup:
    """G4 / G11 fit: code = order of first appearance (by ``order_by``) of the text value."""
    first = (df.where(F.col(q(col)).isNotNull())
             .groupBy(_text(col).alias("_v")).agg(F.min(F.col(q(order_by))).alias("_first")))
    return _codes_from_order(first, "_first")


def label_encode(df: DataFrame, col: str, order_by: str) -> DataFrame:
    """First-appearance codes; missing stays missing."""
    return _replace(df, col, fit_label_first(df, col, order_by))


def _replace(df: DataFrame, col: str, lk: Lookup) -> DataFrame:
    if lk.pairs is not None:
        return df.select(*[lk.expr(_text(c)).alias(c) if c == col else F.col(q(c)) for c in df.columns])
    out = lk.apply(df, _text(col), "_enc")
    return out.select(*[F.col("_enc").alias(c) if c == col else F.col(q(c)) for c in df.columns])


def fit_label_sorted(df: DataFrame, col: str, missing_as_text: bool = True) -> Lookup:
    """G5 / G17 fit: code = lexicographic rank of the text value ('nan' for missing when asked)."""
    v = F.coalesce(_text(col), F.lit(NAN_TEXT)) if missing_as_text else _text(col)
    vals = df.select(v.alias("_v")).where(F.col("_v").isNotNull()).distinct()
    return _codes_from_order(vals.withColumn("_o", F.col("_v")), "_o")


def label_encode_sorted(df: DataFrame, col: str, missing_as_text: bool = True) -> DataFrame:
    """Sorted codes; missing becomes the text 'nan' and gets a code."""
    lk = fit_label_sorted(df, col, missing_as_text)
    key = F.coalesce(_text(col), F.lit(NAN_TEXT)) if missing_as_text else _text(col)
    if lk.pairs is not None:
        return df.select(*[lk.expr(key).alias(c) if c == col else F.col(q(c)) for c in df.columns])
    out = lk.apply(df, key, "_enc")
    return out.select(*[F.col("_enc").alias(c) if c == col else F.col(q(c)) for c in df.columns])


def ordinal_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted category index for several columns (missing stays missing)."""
    out = df
    for c in cols:
        out = label_encode_sorted(out, c, missing_as_text=False)
    return out


MAX_ONE_HOT_LEVELS = 10_000  # one output column per level: beyond this a projection is not a sane plan


def fit_one_hot_levels(df: DataFrame, col: str, limit: int | None = None) -> list[str]:
    """Sorted distinct text values; more than ``limit`` (default ``MAX_ONE_HOT_LEVELS``) is an error.

    The distinct count is checked before any level reaches the driver, and no level is ever
    dropped: a column over the bound raises instead of being truncated.
    """
    bound = limit if limit is not None else MAX_ONE_HOT_LEVELS
    vals = df.select(_text(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    n = vals.count()
    if n > bound:
        raise ValueError(f"{col} has {n} levels, more than {bound}: use sparse.one_hot_sparse")
    return sorted(r["_v"] for r in vals.collect())


def one_hot_exprs(col: str, levels: list[str], drop_first: bool = True, prefix: str | None = None) -> list[Column]:
    keep = levels[1:] if drop_first else levels
    p = prefix or col
    return [F.coalesce((_text(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{p}_{v}") for v in keep]


def one_hot(df: DataFrame, col: str, drop_first: bool = True, prefix: str | None = None) -> DataFrame:
    """``<col>_<value>`` 0/1 columns appended at the end, source dropped; missing -> all 0."""
    levels = fit_one_hot_levels(df, col)
    rest = [F.col(q(c)) for c in df.columns if c != col]
    return df.select(*rest, *one_hot_exprs(col, levels, drop_first, prefix))


def one_hot_full(df: DataFrame, cols: list[str]) -> DataFrame:
    """All levels kept."""
    out = df
    for c in cols:
        out = one_hot(out, c, drop_first=False)
    return out


def fit_frequency(df: DataFrame, col: str) -> Lookup:
    """G7 fit: share of each text value among non-missing values."""
    t = _text(col)
    total = df.agg(F.count(t).alias("n")).first()["n"] or 0
    counts = df.select(t.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.select("_v", (F.col("_n") / F.lit(float(total) if total else 1.0)).alias("_s"))
    return Lookup.fit(shares, "_v", "_s")


def frequency_encode(df: DataFrame, col: str, suffix: str = "_freq") -> DataFrame:
    """``<col>_freq`` appended, source dropped."""
    lk = fit_frequency(df, col)
    rest = [F.col(q(c)) for c in df.columns if c != col]
    if lk.pairs is not None:
        return df.select(*rest, lk.expr(_text(col)).alias(col + suffix))
    out = lk.apply(df, _text(col), col + suffix)
    return out.select(*rest, F.col(q(col + suffix)))


def fit_boollike(df: DataFrame, col: str) -> bool:
    """G9 fit: every trimmed lower-case text value is in the boolean vocabulary."""
    norm = F.lower(F.trim(_text(col)))
    r = df.agg(F.count(norm).alias("n"),
               F.count_if(norm.isNotNull() & ~norm.isin(*BOOL_LIKE.keys())).alias("bad")).first()
    return r["n"] > 0 and r["bad"] == 0


def boollike_expr(col: str) -> Column:
    norm = F.lower(F.trim(_text(col)))
    out = F.lit(None).cast("double")
    for k, v in BOOL_LIKE.items():
        out = F.when(norm == F.lit(k), F.lit(float(v))).otherwise(out)
    return out


def boollike_text(df: DataFrame, col: str) -> DataFrame:
    """Bool-like text -> 0/1 (unchanged when any value is outside the vocabulary)."""
    if not fit_boollike(df, col):
        return df
    return df.select(*[boollike_expr(c).alias(c) if c == col else F.col(q(c)) for c in df.columns])


def epoch_seconds(c: str, dt) -> Column:
    """Seconds since 1970-01-01 as double (time-zone free for TIMESTAMP_NTZ), missing kept."""
    x = F.col(q(c))
    if dt.simpleString() == "timestamp_ntz":
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {q(c)})")
        return micros.cast("double") / 1e6
    if dt.simpleString() == "date":
        return F.unix_date(x).cast("double") * 86400.0
    return F.unix_micros(x).cast("double") / 1e6


def datetime_to_epoch(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """G10."""
    cols = cols or [c for c in df.columns if is_temporal(df.schema[c].dataType)]
    return df.select(*[epoch_seconds(c, df.schema[c].dataType).alias(c) if c in cols else F.col(q(c))
                       for c in df.columns])


def binarise_label(df: DataFrame, col: str, positive) -> DataFrame:
    """1 where equal to ``positive``, else 0."""
    return df.select(*[F.when(F.col(q(c)) == F.lit(positive), 1).otherwise(0).alias(c) if c == col else F.col(q(c))
                       for c in df.columns])


def age_from_year(df: DataFrame, col: str, ref_year: int, out: str | None = None) -> DataFrame:
    """Reference year minus year; source dropped (reference year is an argument, not the clock)."""
    rest = [F.col(q(c)) for c in df.columns if c != col]
    return df.select(*rest, (F.lit(ref_year) - F.col(q(col))).alias(out or f"{col}_age"))


# ---- Yeo-Johnson ---------------------------------------------------------

def yj_expr(x: Column, lam: float) -> Column:
    pos = (F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam)
    neg = (-F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _yj_loglik(df: DataFrame, cols: list[str], lams: dict[str, list[float]]) -> dict[str, list[float]]:
    aggs = []
    for c in cols:
        x = finite(F.col(q(c)))
        aggs += [F.count(x).alias(f"n_{c}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"sl_{c}")]
        for i, lam in enumerate(lams[c]):
            y = yj_expr(x, lam)
            aggs.append(F.var_pop(y).alias(f"v_{c}_{i}"))
    r = df.agg(*aggs).first()
    out = {}
    for c in cols:
        n, sl = r[f"n_{c}"], r[f"sl_{c}"] or 0.0
        ll = []
        for i, lam in enumerate(lams[c]):
            v = r[f"v_{c}_{i}"]
            ll.append(-math.inf if not v or v <= 0 else -n / 2.0 * math.log(v) + (lam - 1.0) * sl)
        out[c] = ll
    return out


@dataclass
class YeoJohnsonParams:
    lambdas: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)

    def expr(self, c: str) -> Column:
        y = yj_expr(finite(F.col(q(c))), self.lambdas[c])
        s = self.stds[c] or 1.0
        return (y - F.lit(self.means[c])) / F.lit(s)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expr(c).alias(c) if c in self.lambdas else F.col(q(c)) for c in df.columns])


    def sql(self, c: str) -> str:
        """``expr`` as SQL text."""
        lam, x = float(self.lambdas[c]), f"CAST({q(c)} AS DOUBLE)"
        pos = f"ln(1 + {x})" if abs(lam) < 1e-12 else f"(power({x} + 1, {lam!r}D) - 1) / ({lam!r}D)"
        neg = f"-ln(1 - {x})" if abs(lam - 2) < 1e-12 else f"-(power(1 - {x}, {2 - lam!r}D) - 1) / ({2 - lam!r}D)"
        value = f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"
        whole = f"CASE WHEN isnan({x}) OR abs({x}) = double('infinity') THEN NULL ELSE {value} END"
        return f"(({whole}) - ({self.means[c]!r}D)) / ({(self.stds[c] or 1.0)!r}D)"

    def stage(self, suffix: str = "_yj"):
        """A pipeline stage that adds each transformed column as ``<column><suffix>``; it saves like Spark's own."""
        from pyspark.ml.feature import SQLTransformer
        items = ", ".join(f"{self.sql(c)} AS {q(c + suffix)}" for c in self.lambdas)
        return SQLTransformer(statement=f"SELECT *, {items} FROM __THIS__")


def fit_yeo_johnson(df: DataFrame, cols: list[str], lo: float = -4.0, hi: float = 4.0,
                    points: int = 17, rounds: int = 5) -> YeoJohnsonParams:
    """G16 fit: lambda by maximum likelihood (grid + refinement, one wide aggregate per round),
    then the mean / population std of the transformed column for standardising."""
    centre = {c: (lo + hi) / 2 for c in cols}
    half = (hi - lo) / 2
    best = {c: 1.0 for c in cols}
    for _ in range(rounds):
        lams = {c: [centre[c] - half + 2 * half * i / (points - 1) for i in range(points)] for c in cols}
        ll = _yj_loglik(df, cols, lams)
        for c in cols:
            i = max(range(points), key=lambda k: ll[c][k])
            best[c] = lams[c][i]
            centre[c] = best[c]
        half = 2 * half / (points - 1) * 2
    p = YeoJohnsonParams(lambdas=best)
    aggs = []
    for c in cols:
        y = yj_expr(finite(F.col(q(c))), best[c])
        aggs += [F.avg(y).alias(f"m_{c}"), F.stddev_pop(y).alias(f"s_{c}")]
    r = df.agg(*aggs).first()
    for c in cols:
        p.means[c], p.stds[c] = r[f"m_{c}"], r[f"s_{c}"]
    return p


# ---- whole-table encoding (Step 10) --------------------------------------

@dataclass
class EncodeParams:
    steps: list = field(default_factory=list)  # (column, strategy, payload)

    def report(self, spark) -> DataFrame:
        """Column -> strategy."""
        return spark.createDataFrame([(c, s) for c, s, _ in self.steps], "column_name string, strategy string")

    def transform(self, df: DataFrame) -> DataFrame:
        plans = {c: (s, p) for c, s, p in self.steps}
        out = df
        joined = {}
        for c, (s, p) in plans.items():
            if isinstance(p, Lookup) and p.pairs is None:
                out = p.apply(out, _text(c), f"__{c}")
                joined[c] = f"__{c}"
        keep, appended = [], []
        for c in df.columns:
            if c not in plans:
                keep.append(F.col(q(c)))
                continue
            s, p = plans[c]
            src = None
            if isinstance(p, Lookup):
                src = F.col(q(joined[c])) if c in joined else p.expr(_text(c))
            if s == "Boolean -> 0/1":
                keep.append(F.col(q(c)).cast("int").alias(c))
            elif s.startswith("Label Encoding") or s.startswith("Factorize"):
                keep.append(src.alias(c))
            elif s.startswith("One-Hot"):
                appended += one_hot_exprs(c, p, drop_first=True)
            elif s.startswith("Frequency"):
                appended.append(src.alias(c + "_freq"))
            elif s == "Datetime -> Unix timestamp":
                keep.append(epoch_seconds(c, df.schema[c].dataType).alias(c))
            elif s == "Boolean-like text -> 0/1":
                keep.append(boollike_expr(c).alias(c))
            else:
                keep.append(F.col(q(c)))
        return out.select(*keep, *appended)


def fit_encode_table(df: DataFrame, method: str = "auto", max_onehot: int = MAX_ONEHOT,
                     order_by: str | None = None, protect: list[str] | None = None) -> EncodeParams:
    """G13 fit: booleans, text columns by strategy (G4/G6/G7/G8), then leftovers
    (datetime -> epoch, bool-like text -> 0/1, else first-appearance codes)."""
    protect = set(protect or [])
    p = EncodeParams()
    cols = [c for c in df.columns if c not in protect]
    texts = [c for c in cols if is_string(df.schema[c].dataType)]
    u = at_most(df, dict.fromkeys(texts, max(2, max_onehot)))
    order = order_by or df.columns[0]
    for c in cols:
        dt = df.schema[c].dataType
        if is_bool(dt):
            p.steps.append((c, "Boolean -> 0/1", None))
        elif is_string(dt):
            n = u[c]  # None: too many for one-hot
            if method == "label":
                p.steps.append((c, "Label Encoding", fit_label_first(df, c, order)))
            elif method == "onehot":
                if n is not None and n <= max_onehot:
                    p.steps.append((c, "One-Hot Encoding", fit_one_hot_levels(df, c, max_onehot)))
                else:
                    p.steps.append((c, "Frequency Encoding (High Cardinality fallback)", fit_frequency(df, c)))
            elif n == 2:
                p.steps.append((c, "Label Encoding (Binary)", fit_label_first(df, c, order)))
            elif n is not None and n <= max_onehot:
                p.steps.append((c, "One-Hot Encoding (Low Cardinality)", fit_one_hot_levels(df, c, max_onehot)))
            else:
                p.steps.append((c, "Frequency Encoding (High Cardinality)", fit_frequency(df, c)))
        elif is_temporal(dt):
            p.steps.append((c, "Datetime -> Unix timestamp", None))
        elif not is_numeric(dt):
            if fit_boollike(df, c):
                p.steps.append((c, "Boolean-like text -> 0/1", None))
            else:
                p.steps.append((c, "Factorize (final numeric fallback)", fit_label_first(df, c, order)))
    return p


def encode_both(df: DataFrame, col: str, order_by: str, max_onehot: int = MAX_ONEHOT) -> DataFrame:
    """n_unique == 2 -> first-appearance code; <= max_onehot -> one-hot; else frequency."""
    n = at_most(df, {col: max(2, max_onehot)})[col]
    if n == 2:
        return label_encode(df, col, order_by)
    if n is not None and n <= max_onehot:
        return one_hot(df, col)
    return frequency_encode(df, col)


def column_transformer(spec: dict[str, list[str]]):
    """Route column groups to ordinal / one-hot / Yeo-Johnson / standard scaling and
    assemble one feature vector (a ``pyspark.ml`` Pipeline; numeric columns may appear twice)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    stages, outputs = [], []
    oh = spec.get("onehot", [])
    if oh:
        stages.append(StringIndexer(inputCols=oh, outputCols=[f"{c}__idx" for c in oh],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in oh], outputCols=[f"{c}__oh" for c in oh],
                                    dropLast=False, handleInvalid="keep"))
        outputs += [f"{c}__oh" for c in oh]
    ords = spec.get("ordinal", [])
    if ords:
        stages.append(StringIndexer(inputCols=ords, outputCols=[f"{c}__ord" for c in ords],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        outputs += [f"{c}__ord" for c in ords]
    power = spec.get("power", [])
    if power:
        stages.append(YeoJohnsonStage(power))
        outputs += [f"{c}__yj" for c in power]
    std = spec.get("standard", [])
    if std:
        stages.append(VectorAssembler(inputCols=std, outputCol="__std_in", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__std_in", outputCol="__std", withMean=True, withStd=True))
        outputs.append("__std")
    stages.append(VectorAssembler(inputCols=outputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages)


try:
    from pyspark.ml import Estimator, Model
    from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable

    class YeoJohnsonModel(Model, DefaultParamsReadable, DefaultParamsWritable):
        def __init__(self, params: YeoJohnsonParams | None = None):
            super().__init__()
            self._p = params

        def _transform(self, dataset):
            return dataset.select("*", *[self._p.expr(c).alias(f"{c}__yj") for c in self._p.lambdas])

    class YeoJohnsonStage(Estimator):
        """G16 as a pipeline stage."""
        def __init__(self, cols: list[str] | None = None):
            super().__init__()
            self._cols = list(cols or [])

        def _fit(self, dataset):
            return YeoJohnsonModel(fit_yeo_johnson(dataset, self._cols))
except ImportError:  # pragma: no cover
    YeoJohnsonStage = None
