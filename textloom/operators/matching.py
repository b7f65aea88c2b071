"""Fuzzy matches between short texts, where a ratio of matching blocks is asked for.

The ratio has no counterpart among built-in functions, so it runs in Arrow batches; fuzzy.py finds the pairs that need it.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import jaccard, similarity_tokens, text
from . import fuzzy


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matching characters / all characters, between 0 and 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def text_similarity(a: str, b: str) -> Column:
    """The larger of the Jaccard similarity of words and CJK characters and the ratio of matching blocks."""
    return F.greatest(jaccard(similarity_tokens(F.col(a)), similarity_tokens(F.col(b))), ratio(F.trim(text(a)), F.trim(text(b))))


def best_headings(keys: DataFrame, headings: DataFrame, by: list[str], least: float = 0.35) -> DataFrame:
    """by, key, heading, score: the heading nearest to each template key; .3 more if one holds the other; none under `least`."""
    best = fuzzy.best_matches(keys, headings, "key", "heading", by, least, fuzzy.Score(bonus=0.3)).drop("scored")
    return keys.join(best, [*by, "key"], "left")


def match_sources(cites: DataFrame, sources: DataFrame, by: list[str], least: float = 0.35) -> DataFrame:
    """by, cite, source, score: 1 where one holds the other, else the ratio; null source under `least`. Of a citation with no better
    match than one half, the first source that holds one of its words."""
    best = fuzzy.best_matches(cites, sources, "cite", "source", by, least, fuzzy.Score(whole=1.0, weak=0.5)).drop("scored")
    return cites.join(best, [*by, "cite"], "left")


def bad_citations(cites: DataFrame, sources: DataFrame, by: list[str], least: float = 0.35, most: int = 10) -> DataFrame:
    """Citations without a source, with the last good one before them to fill in."""
    rows = match_sources(cites, sources, by, least)
    before = F.last(F.when(F.col("source").isNotNull(), F.col("cite")), ignorenulls=True).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    bad = rows.withColumn("fill", before).where("source IS NULL")
    return bad.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where(F.col("n") <= most).drop("n", "source", "score")


def find_section(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, wanted, title: a section by its title, else the one that holds or is held by it and shares most characters."""
    pairs = wanted.join(sections, "doc_id")
    chars = lambda c: F.array_distinct(F.split(text(c), ""))
    share = F.size(F.array_intersect(chars("wanted"), chars("title"))) / F.greatest(F.size(F.array_union(chars("wanted"), chars("title"))), F.lit(1))
    score = F.when(F.col("wanted") == F.col("title"), 2.0).when(F.contains("title", F.col("wanted")) | F.contains("wanted", F.col("title")), share).otherwise(0.0)
    w = Window.partitionBy("doc_id", "wanted").orderBy(F.desc("score"), "order_index")
    return pairs.withColumn("score", score).where("score > 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "wanted", "title")


def region(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Text items with the first region (header, body, footer) of their page whose text holds them; body otherwise."""
    pairs = items.join(regions, "page").where(F.contains("region_text", F.col("text")))
    first = pairs.groupBy("page", "item").agg(F.min_by("region", "region_order").alias("region"))
    return items.join(first, ["page", "item"], "left").withColumn("region", F.coalesce("region", F.lit("body")))
