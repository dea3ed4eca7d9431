"""The ten operators as queries over whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, bpe, exact_dedup, kneser_ney, language_id, minhash, packing, quality_rules, sharding, token_output

#: Bytes of a shard of fine_shards; the largest texts of the small tables have about half as many.
FINE = 64 << 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(source=f"{sf_dir}/documents.parquet", spark=spark)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_filter(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), score="perplexity")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def fine_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_sharding with a limit that splits small tables into many uneven shards, so that SQL sees splits."""
    return sharding.shards(_table(spark, sf_dir, "documents"), FINE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_lm_scoring, op3_packing, op4_bpe, op5_token_output, op6_quality_classifier, op7_language_id, op8_quality_rules, op9_near_dedup, op10_sharding, fine_shards)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents)
WHERE place = 1 OR text IS NULL
""",
    "op10_sharding": sharding.oracle(),
    "fine_shards": sharding.oracle(FINE),
}
