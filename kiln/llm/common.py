"""Shared plumbing of the operators: saved intermediate tables, checked broadcasts, id hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import checkpoint_dir, ship_package

#: A side with at most so many narrow rows (ids and a few numbers) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Row groups of intermediate tables; a writing task holds one in memory.
ROW_GROUP_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ready(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: it cuts the lineage, and
    later readers prune columns and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``limit`` rows, else as it is (then the
    join shuffles). Give it saved tables: the count reads no columns."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")) % by
