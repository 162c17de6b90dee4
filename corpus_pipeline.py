"""A training corpus from `documents`: quality rules, near-duplicates, personal data, source mix, tokens.

Every stage reads all that the one before it kept. The first four return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demogrid.llm import bpe, jaccard, mixing, pii, quality
from demogrid.llm.queries import SAMPLE_KEY, vocabulary_path
from demogrid.session import scratch_path

#: A stage on word-level similarity, keys and mappings cannot be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not mostly lines that many documents of their source share, without
    these lines, as long as what is left passes the base rules too; ``n_chars`` follows the text where it changed."""
    kept = quality.quality_rules(docs, cleaned=True).filter("kept and not clean_failed")
    changed = F.col("removed_share") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
                           ).withColumn("text", F.col("clean_text")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group linked by word-shingle similarity."""
    return jaccard.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return pii.replace_entities(docs, SAMPLE_KEY).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document may appear twice, or as a piece."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    coded = bpe.round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), vocabulary_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("source_mix", source_mix), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
