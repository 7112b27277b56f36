"""The corpus pipeline: documents to token ids, in five stages that each call one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, minhash, mixing, quality_rules, sentencepiece_viterbi
from tarn.llm.common import stage_table, table

#: Token shares of the production mix.
TARGETS = mixing.Targets()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are taken out of the others."""
    out = quality_rules.clean_documents(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, the document with the least id stays."""
    return minhash.drop_near_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the token shares of TARGETS, each category to its own."""
    return mixing.sample_documents(docs, TARGETS, classes=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every document."""
    out = sentencepiece_viterbi.encode(docs, keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("mixing to target weights", mix),
    ("sentencepiece encoding", tokenize),
]

#: SQL can express neither connected groups nor raking nor encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{k}")
    return docs
