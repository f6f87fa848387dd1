"""G6 / G18 / M1 for columns with many levels: sparse one-hot rows through a fitted, joined dictionary.

``encode.one_hot`` makes one output column per level, which a projection bears up to some thousand
levels. Here a level is a slot number. The dictionary (column, level, slot) is a table: levels are
numbered by distributed positions within their column and never come to the driver; rows meet it by
an equi-join per column (Spark broadcasts a small side by itself and splits skewed keys).
A row is a struct with the fields of a sparse ``pyspark.ml`` vector, so SQL can read its slots;
``as_vectors`` turns it into that type without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import finite, is_numeric, is_string, is_temporal, q
from kiln.functions.ordering import segment_index
from kiln.operators.clean import all_null_columns, column_medians
from kiln.operators.encode import epoch_seconds
from kiln.operators.select import zero_variance_columns
from kiln.session import saved

#: the field of a sparse vector that tells it from a dense one
SPARSE = 0


@dataclass
class SparseEncoder:
    """Slots 0 .. len(numeric) - 1 hold the numeric columns, then each text column's levels in text order."""
    numeric: list[str]
    text: list[str]
    slots: DataFrame  # (column_name, level, slot), one row per kept level
    size: int

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """The encoded columns give way to ``out``. A missing or unseen level has no slot (all zeros), a
        missing number is 0."""
        j = df
        for i, c in enumerate(self.text):
            one = self.slots.where(F.col("column_name") == c).select(F.col("level").alias(f"_level{i}"), F.col("slot").alias(f"_slot{i}"))
            j = j.join(one, F.col(q(c)).cast("string") == F.col(f"_level{i}"), "left")
        hot = F.array_compact(F.array(*[F.col(f"_slot{i}") for i in range(len(self.text))]).cast("array<int>"))
        numbers = F.array(*[F.coalesce(F.col(q(c)).cast("double"), F.lit(0.0)) for c in self.numeric]).cast("array<double>")
        places = F.array(*[F.lit(i) for i in range(len(self.numeric))]).cast("array<int>")
        row = F.struct(F.lit(SPARSE).cast("tinyint").alias("type"), F.lit(self.size).alias("size"),
                       F.concat(places, hot).alias("indices"),
                       F.concat(numbers, F.array_repeat(F.lit(1.0), F.size(hot))).alias("values"))
        coded = set(self.numeric) | set(self.text)
        return j.select(*[F.col(q(c)) for c in df.columns if c not in coded], row.alias(out))

    def names(self) -> DataFrame:
        """(slot, name): what each slot stands for."""
        numbers = self.slots.sparkSession.createDataFrame(list(enumerate(self.numeric)), "slot int, name string")
        return numbers.unionByName(self.slots.select("slot", F.concat_ws("_", "column_name", "level").alias("name")))


def fit_sparse(df: DataFrame, text: list[str], numeric: list[str] | None = None, drop_first: bool = True) -> SparseEncoder:
    """Number the levels of all ``text`` columns at once; ``drop_first`` leaves each column's first level out."""
    numeric = list(numeric or [])
    spark = df.sparkSession
    if not text:
        return SparseEncoder(numeric, [], spark.createDataFrame([], "column_name string, level string, slot int"), len(numeric))
    wide = df.select(*[F.col(q(c)).cast("string").alias(c) for c in text])
    levels = wide.unpivot([], [F.col(q(c)) for c in text], "column_name", "level").where(F.col("level").isNotNull()).distinct()
    first = 1 if drop_first else 0
    ranked = saved(segment_index(levels, "column_name", ["level"], "_i").where(F.col("_i") >= first), "levels")
    kept = {r[0]: r[1] for r in ranked.groupBy("column_name").count().collect()}  # one row per column
    start, at = F.lit(None).cast("long"), len(numeric)
    for c in text:
        start = F.when(F.col("column_name") == c, F.lit(at).cast("long")).otherwise(start)
        at += kept.get(c, 0)
    if at > 2**31 - 1:
        raise ValueError(f"{at} slots: a Spark vector holds 2,147,483,647")
    slots = ranked.select("column_name", "level", (start + F.col("_i") - first).cast("int").alias("slot"))
    return SparseEncoder(numeric, list(text), slots, at)


def one_hot_sparse(df: DataFrame, cols: list[str], drop_first: bool = True, out: str = "features") -> DataFrame:
    """G6 (first level left out) / G18 (all kept) for any number of levels."""
    return fit_sparse(df, cols, drop_first=drop_first).transform(df, out)


def fill_and_fit(df: DataFrame, id_col: str) -> tuple[DataFrame, SparseEncoder]:
    """M1's filled columns and the encoder fitted on them."""
    keep = [c for c in df.columns if c != id_col]
    dead = set(all_null_columns(df.select(*[q(c) for c in keep]))) if keep else set()
    cols = [c for c in keep if c not in dead]
    base = df.select(q(id_col), *[epoch_seconds(c, df.schema[c].dataType).alias(c) if is_temporal(df.schema[c].dataType)
                                  else F.col(q(c)) for c in cols])
    nums = [c for c in cols if is_numeric(base.schema[c].dataType)]
    texts = [c for c in cols if is_string(base.schema[c].dataType)]
    med = column_medians(base, nums)
    modes = _modes(base, texts)
    filled = base.select(q(id_col), *[F.coalesce(finite(F.coalesce(F.col(q(c)).cast("double"), F.lit(med[c]))), F.lit(0.0)).alias(c) for c in nums],
                         *[F.coalesce(F.col(q(c)), F.lit(modes[c])).alias(c) for c in texts])
    flat = set(zero_variance_columns(filled, nums, fill_zero=True))
    return filled.drop(*flat), fit_sparse(filled, texts, [c for c in nums if c not in flat])


def sparse_matrix(df: DataFrame, id_col: str) -> DataFrame:
    """M1 as (id, features): the cells of ``unsupervised_matrix`` for any number of levels. A level kept
    here is neither absent nor everywhere, so only numeric columns can be without variance."""
    filled, encoder = fill_and_fit(df, id_col)
    return encoder.transform(filled)


def _modes(df: DataFrame, texts: list[str]) -> dict[str, str | None]:
    """Most frequent value of each text column, the smallest among equals: one row per column."""
    if not texts:
        return {}
    counts = (df.select(*[q(c) for c in texts]).unpivot([], [F.col(q(c)) for c in texts], "column_name", "value")
              .where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.negative(F.count(F.lit(1))).alias("n")))
    top = counts.groupBy("column_name").agg(F.min(F.struct("n", "value")).alias("m"))
    found = {r["column_name"]: r["m"]["value"] for r in top.collect()}
    return {c: found.get(c) for c in texts}


def as_vectors(df: DataFrame, col: str = "features") -> DataFrame:
    """``df`` with the struct ``col`` as a ``pyspark.ml`` vector: written once (fits read it many times)
    and read again under the vector type, whose stored form the struct is."""
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == col else f.dataType) for f in df.schema])
    return saved(df, "vectors", schema)
