"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents go, one document
of each near-duplicate group stays, repeated bytes and secrets leave the texts, and the last stage packs what is left.
Every stage but the last returns the columns of documents; n_chars follows the text where a stage changes it.

Defined cases are those of the operators: null texts are empty (the quality rules reject them), repeated rows stay
repeated until near-duplicates are removed, an empty table passes through, other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import neardup, packing, quality, secrets, suffixes
from tideline.session import cut, ship, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(docs.withColumn("_row", F.struct(*docs.columns)), keep=("_row",)))
    return rows.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, told by id and text; a repeated row stays once."""
    ship(spark)
    return neardup.survivors(docs, width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _measured(suffixes.cleaned(docs, length=100))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _measured(secrets.redact(docs, secrets.train(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Near-duplicate components and token ids can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
