"""A corpus pipeline over documents: each stage works on all that its predecessor kept, and its decisions take effect.

Nothing but the language filter and the near-duplicate stage removes documents; the dedup stages shorten texts, and a
document that loses all of its text stays as an empty one. The last stage gives the packed pieces with their token ids.

Defined cases, for all stages: an empty table gives an empty result; further columns pass through, whatever their names; a
null text has no letters, so it goes in the first stage; a row without doc_id neither makes others lose anything nor loses
anything itself; of equal texts and lines the smallest doc_id keeps its own; rows that repeat share their fate in the dedup
stages, and both stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import Scratch
from textloom.llm.langid import language_filter
from textloom.llm.line_dedup import line_dedup
from textloom.llm.near_copies import near_dedup
from textloom.llm.packing import pack
from textloom.llm.substring_dedup import substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the languages that the labelled ones teach, go."""
    return language_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id holds go."""
    return line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links and near copies (five-word shingles, similarity 0.8) connect, the smallest doc_id stays."""
    return near_dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word passages that a document with a smaller doc_id holds go."""
    return substring_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with token ids, sequence and place in it."""
    return pack(docs, with_ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_copies), ("substring_dedup", passages), ("best_fit_packing", packed)]

ORACLE_SQL = None  # fingerprints and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
