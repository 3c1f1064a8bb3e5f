"""A training corpus in five stages over `documents`: toxicity, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.llm.common import Scratch
from terralex.llm.minhash import minhash_dedup
from terralex.llm.packing import pack
from terralex.llm.pii import mask_pii
from terralex.llm.substring_dedup import substring_dedup
from terralex.llm.toxicity import fit, without_toxic


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars anew, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a model, fitted on the labelled ones outside the held-out fold, predicts to be toxic."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by a similarity of 0.8 of the sets of five-word shingles."""
    dropped = minhash_dedup(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 20 words or more that occurred before; documents stay, if only with an empty text."""
    return _counted(substring_dedup(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return _counted(mask_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("personal_data", personal_data), ("packing", packing)]

#: SQL can't express the classifiers and the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, with a table in shared storage between them."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(before)
        scratch.release_shuffles()
    return STAGES[-1][1](spark, docs, sf_dir)
