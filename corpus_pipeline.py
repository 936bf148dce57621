"""The training-text pipeline: each stage reads the table that the one before it wrote.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm.common import Scratch, table
from clickloom.llm.decontaminate import decontaminate
from clickloom.llm.line_dedup import dedup_lines
from clickloom.llm.packing import pack
from clickloom.llm.simhash import drop_near_duplicates
from clickloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels of documents that are not in ``docs`` teach nothing."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, documents stay; ``n_chars``, where it is there, follows the text."""
    out = dedup_lines(docs, Scratch(spark, "line-dedup"))
    if "n_chars" in docs.columns:
        out = out.selectExpr(*(f"`{c}`" if c != "n_chars" else f"cast(char_length(text) as {docs.schema['n_chars'].dataType.simpleString()}) as n_chars" for c in docs.columns))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return drop_near_duplicates(docs, Scratch(spark, "near-dedup"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as packed token pieces."""
    return pack(docs, Scratch(spark, "packing"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier and a tokenizer are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's table written and read again."""
    docs, between = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = between.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
