"""A corpus pipeline of four stages: each reads the Parquet table that the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import drop_kept, keep, table
from quillspark.llm.op1_quality import classify
from quillspark.llm.op4_simhash import one_of_each
from quillspark.llm.op5_pii import KEY, pseudonymise
from quillspark.llm.op9_packing import packed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to these documents, rejects go."""
    return classify(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles stays."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars is that of the new text."""
    out = pseudonymise(docs, KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document's pieces and their places in sequences of 4096."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
#: The label model, its scorer, fingerprints and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        written = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_kept(docs)  # what the stage before has written
        docs = written
    return STAGES[-1][1](spark, docs, sf_dir)
