"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kiln.llm.common import documents, ready, scratch_path
from kiln.llm.count_transducer import token_counts
from kiln.llm.decontaminate import contaminated_windows
from kiln.llm.hard_negatives import mine_embeddings
from kiln.llm.importance import resample
from kiln.llm.minhash_dedup import near_duplicates
from kiln.llm.nb_svm import classify
from kiln.llm.oracles import ORACLE  # noqa: F401 - read by the driver's entry file
from kiln.llm.packing import packed
from kiln.llm.pii_fpe import pseudonymise
from kiln.llm.ppm import score_documents
from kiln.llm.quality_mcd import quality_rules
from kiln.llm.token_files import read_token_files, write_token_files
from kiln.llm.url_rules import url_filter
from kiln.llm.warc import read_archives, write_archives


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark.range(0))
    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, _tokenizer("byte_bpe_50k.json"), end=0)
    return read_token_files(spark, path, digest=True)


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir)).select("doc_id", "text", "n_replaced")


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_windows(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "shared", "total")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(documents(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end=0)


def op10_count_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine_embeddings(documents(spark, sf_dir, "embeddings"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(documents(spark, sf_dir, "pages"), path, least=0)
    found = read_archives(spark, path, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_token_files, op3_ppm_score, op4_quality_classifier, op5_pii_pseudonyms, op6_quality_mcd, op7_decontaminate, op8_url_rules, op9_best_fit_packing, op10_count_transducer,
                                  op11_hard_negatives, op12_importance_resampling, op13_warc_revisits)}
