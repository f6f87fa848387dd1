"""A: reading, ordering, previews and writing.

CSV input follows the pandas reading contract: header row, a set of
missing-value tokens, inferred column types. Types are inferred by ONE
aggregate over the text columns (share of values that ``try_cast``
accepts), not by a driver-side sample, so the schema reflects the whole
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.functions.exprs import q
from kiln.session import cut_lineage

# Text read as missing (the pandas default NA tokens).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_table(spark: SparkSession, path: str, fmt: str | None = None, na_values: list[str] | None = None,
               parse_dates: bool = False, multi_line: bool = True) -> DataFrame:
    """A1: read Parquet (typed) or CSV with header, NA tokens -> NULL, inferred types.

    Quoted fields may hold commas, doubled quotes and, with ``multi_line``, line breaks; a file is
    then read by one task, so turn it off for large files that are known to have none.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
           .option("multiLine", multi_line).csv(path))
    tokens = NA_TOKENS if na_values is None else na_values
    cleaned = raw.select(*[F.when(F.col(q(c)).isin(*tokens), F.lit(None).cast("string"))
                           .otherwise(F.col(q(c))).alias(c) for c in raw.columns])
    return infer_types(cleaned, parse_dates=parse_dates)


def infer_types(df: DataFrame, parse_dates: bool = False) -> DataFrame:
    """Cast text columns whose every non-null value parses as long / double
    (/ timestamp when ``parse_dates``), decided by one aggregate."""
    cols = [c for c in df.columns if df.schema[c].dataType.simpleString() == "string"]
    if not cols:
        return df
    aggs = []
    for c in cols:
        x = F.col(q(c))
        aggs += [F.count(x).alias(f"n_{c}"),
                 F.count(x.try_cast("long")).alias(f"l_{c}"),
                 F.count(x.try_cast("double")).alias(f"d_{c}")]
        if parse_dates:
            aggs.append(F.count(F.try_to_timestamp(x)).alias(f"t_{c}"))
    r = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        if c not in cols or r[f"n_{c}"] == 0:
            out.append(F.col(q(c)))
        elif r[f"l_{c}"] == r[f"n_{c}"]:
            out.append(F.col(q(c)).try_cast("long").alias(c))
        elif r[f"d_{c}"] == r[f"n_{c}"]:
            out.append(F.col(q(c)).try_cast("double").alias(c))
        elif parse_dates and r[f"t_{c}"] == r[f"n_{c}"]:
            out.append(F.try_to_timestamp(F.col(q(c))).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)


def with_row_order(df: DataFrame, by: str | None = None, name: str = "_row_id") -> DataFrame:
    """A3: an explicit order. A caller key adds nothing; otherwise a row id, fixed by a checkpoint
    so that later evaluations see the same ids."""
    if by is not None:
        return df
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


def preview(df: DataFrame, n: int = 10, by: str = "_row_id") -> DataFrame:
    """A4: the first n rows in key order (TakeOrderedAndProject: bounded by n)."""
    return df.orderBy(by).limit(n)


def textual_view(df: DataFrame, cols: list[str]) -> DataFrame:
    """Any value as text, missing stays missing."""
    return df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A5: export the cleaned table (CSV with header, or Parquet); written in parallel by all tasks."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small result table (one row per model / column) as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)


def save_model(model, path: str) -> None:
    """Persist a fitted ``pyspark.ml`` model or pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Load a model saved by ``save_model``: a pipeline, or a single stage of Spark's or ours."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import DefaultParamsReader
    spark = SparkSession.active()
    kind = DefaultParamsReader.loadMetadata(path, spark)["class"]
    if kind.rsplit(".", 1)[-1] == "PipelineModel":
        return PipelineModel.load(path)
    return DefaultParamsReader.loadParamsInstance(path, spark)
