"""The corpus pipeline: stages that each work on all that the one before kept."""

from __future__ import annotations

from entitymill.llm.common import Scratch, table
from entitymill.llm.near_dedup import distinct_documents
from entitymill.llm.packing import pack
from entitymill.llm.personal_data import mask_personal_data
from entitymill.llm.quality_rules import passing_documents
from entitymill.llm.subword_classifier import good_documents
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Learned models decide two stages and packing is sequential, so SQL can't say the whole; brute force tests the stages.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return passing_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: five-word shingles, similarity 0.8; of repeated rows one."""
    return distinct_documents(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text, other texts stay as they are."""
    masked = mask_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document gets its place in a training sequence of 2,048 words."""
    return pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), ""
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
