"""A training-data pipeline over ``documents``: five stages, each written as a table and read again as the next one's input.

A stage is a function ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perilgrid.llm import bpe, decontam, lines, quality, simhash
from perilgrid.llm.runtime import Frozen


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the classifier is trained on the labelled ones among the stage's input."""
    model = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(spark, docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share."""
    return lines.drop_boilerplate(spark, docs)


def simhash_near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, and links that are verified at a similarity of 0.8. SimHash
    links at a few bits are among the candidates, but miss most pairs of that similarity; see ``perilgrid.llm.similar``."""
    return simhash.keep_one_similar(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.digest_texts(spark, docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: SQL can't express the stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a table in the shared folder."""
    docs, frozen = spark.read.parquet(f"{sf_dir}/documents.parquet"), Frozen(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
