"""A training-corpus pipeline over ``documents``: each stage is written and read again.

A stage takes what its predecessor kept and, but for the last, returns the columns of
documents, whatever their nulls, repeated rows, very long or empty texts; an empty table
gives an empty one. What an operator does in such cases stands in its own docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, near_dedup, packing, quality_rules, queries, shared, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; null and empty texts carry no evidence and stay."""
    return toxicity.clean_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the limits of coverage; null and empty texts have no words and go."""
    return quality_rules.kept_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id; rows that repeat an id stay or go together."""
    return near_dedup.kept_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, shuffled: a copy is a row like its first."""
    return mixing.mixed(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences; copies of a document are pieces of their own with the same columns and other places."""
    return packing.pack(docs.select("doc_id", "text"), queries.tokenizer_file())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_rules_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and numpy hashing decide the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
