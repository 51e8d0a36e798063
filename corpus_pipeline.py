"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read back as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenledger.llm import darts, mixing, packing, relative_lz, rules
from tokenledger.llm.queries import TOKENIZER
from tokenledger.llm.tables import load, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counting rules or the quality model go."""
    return rules.filter(docs, rules.train(docs, load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of least id."""
    return darts.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur earlier in the corpus go; documents stay, with what is left of them."""
    return relative_lz.remove(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat at the rate that brings their source to its target."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document and its place in a sequence."""
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

#: Token ids and trained models are not for SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
