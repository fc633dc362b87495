"""A training corpus from raw documents: five stages, each an operator of `siftlake.llm` over all rows that the last one kept.

Every stage but the last returns the columns of `documents`. Nulls, empty and repeated rows are each stage's operator's
defined cases; what a stage adds to them stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import cotraining, line_dedup, mix_cube, ngram_join, sentencepiece_lattice
from siftlake.llm.common import Staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the co-trained classifier calls good; unscored ones (no labels of both kinds) stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.scored(docs.select(*COLUMNS), labels).filter("quality.kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes lines that an earlier document has in an aligned block; a document that loses its last word that way goes."""
    out = line_dedup.deduplicated(docs.select(*COLUMNS))
    changed = F.col("line_dedup.n_deleted") > 0
    return out.filter(~changed | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, 0.8) the rows of its smallest id, one of each text; rows without an id stay."""
    groups = ngram_join.joined(docs.select("doc_id", "text"), n=5, num=80, den=100)
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    known = docs.select(*COLUMNS).filter("doc_id is not null").join(kept, "doc_id", "left_semi")
    known = known.withColumn("same_text", F.xxhash64("text")).dropDuplicates(["doc_id", "same_text"]).select(*COLUMNS)
    return known.unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2; rows that repeat an id are all taken as often as the most taken one."""
    copies = mix_cube.mixed(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    taken = docs.select(*COLUMNS).join(copies, F.col("doc_id").eqNullSafe(F.col("id"))).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return sentencepiece_lattice.encoded(docs.select("doc_id", "text")).withColumn("n_tokens", F.size("ids"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mix_sources", mix), ("sentencepiece", tokens)]

#: EM, patience diff, the cube method and Viterbi aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    docs, staged = spark.read.parquet(f"{sf_dir}/documents.parquet"), Staged(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = staged.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
