"""The corpus pipeline: STAGES applied to documents one after the other, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Part of the llm subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import line_dedup, mixing, ngram_join, queries, toxicity
from tidelake.llm.shared import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the model's threshold stay. The model reads labels of documents that are still here, never those of the held-out fold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("toxic = 0").select(*docs.columns)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; runs of 50 words that an earlier one has go from its text, also inside lines, and n_chars follows."""
    return line_dedup.dedup_words(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays, and every document that is in none. Null ids stay."""
    judged = ngram_join.similar_documents(docs.select("doc_id", "text"))
    gone = judged.where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents as often as it takes them, and the parts of documents where its blocks end."""
    return mixing.take(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row encoded and decoded, as digests of both."""
    return queries.bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_runs),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL cannot express the learned toxicity model, nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage, from the written output of the one before it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"{i}-{name}")
    return docs

