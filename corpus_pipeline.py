"""From raw documents to packed training sequences: the stages, and one run over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.llm.common import documents, save
from kiln.llm.decontaminate import remove_contaminated
from kiln.llm.minhash_dedup import keep_first
from kiln.llm.packing import packed
from kiln.llm.pii_fpe import pseudonymise_documents
from kiln.llm.quality_mcd import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return remove_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by pseudonyms."""
    return pseudonymise_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in full sequences."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), end=0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data),
          ("packing", packing)]

#: Hashing, packing and keyed permutation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each one's result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
