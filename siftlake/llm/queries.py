"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, filter_audit, line_dedup, mih, mix_cube, ngram_join, quality_rules, secret_scan, sentencepiece_lattice, source_divergence, suffix_dedup, token_count, toxicity_pu


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.round_trip(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.size("ids"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_cube.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_dedup.*", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih.neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_quality_rules, op3_mix_sources, op4_line_dedup, op5_token_counts, op6_quality_classifier, op7_secret_scan, op8_multi_index_hashing,
        op9_suffix_dedup, op10_ngram_join, op11_filter_audit, op12_source_divergence, op13_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_filter_audit": filter_audit.SQL, "op12_source_divergence": source_divergence.SQL}
