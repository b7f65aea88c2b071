"""Vector and evaluation metrics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .edits import best_similarity, edit_distance

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def dcg(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 1 for two empty texts; for short ones (edits.py has long ones)."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def anls(prediction: Column, answers: Column) -> Column:
    """Best edit similarity to any answer, ignoring case."""
    return F.coalesce(best_similarity(F.lower(F.trim(prediction)), F.transform(answers, lambda x: F.lower(F.trim(x)))), F.lit(0.0))


def character_error_rate(prediction: Column, truth: Column) -> Column:
    return edit_distance(prediction, truth) / F.greatest(F.length(truth), F.lit(1))


def line_accuracy(prediction: Column, truth: Column) -> Column:
    """Share of the true lines that the prediction has."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    want = lines(truth)
    return F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.size(F.filter(want, lambda x: F.array_contains(lines(prediction), x))) / F.size(want))


def coherence(similarity: Column) -> Column:
    """Score of an average similarity of neighbours: too little and too much are both bad."""
    return F.when(similarity < 0.05, similarity * 10).when(similarity > 0.8, (1 - similarity) * 5).otherwise(F.least(F.lit(1.0), similarity * 2))


def blend(rule: Column, judge: Column, weight: float = 0.4) -> Column:
    """Rule and judge scores mixed, unless there is no judgement."""
    return F.round(F.when(judge > 0, weight * rule + (1 - weight) * judge).otherwise(rule), 3)


def adaptive_k(query: Column, k: int = 60) -> Column:
    """Fusion constant by kind of query; the first rule that holds counts."""
    from .query import concreteness, has_numbers, has_tech

    c = concreteness(query)
    return (
        F.when(has_numbers(query) | has_tech(query), F.greatest(F.lit(30), F.lit(int(k * 0.5))))
        .when(F.length(query) > 60, F.least(F.lit(120), F.lit(int(k * 1.6))))
        .when(c < 0.3, F.least(F.lit(100), F.lit(int(k * 1.4))))
        .when(c > 0.7, F.greatest(F.lit(35), F.lit(int(k * 0.65))))
        .otherwise(F.lit(k))
    )


def context_budget(section_type: Column, target_words: Column, cap: Column) -> Column:
    """Characters of context for a section, by kind and length."""
    base = F.when(section_type == "data", 2000).when(section_type == "experiment_setup", 1800).when(section_type == "analysis", 1500).when(section_type == "review", 800).otherwise(1200)
    return F.greatest(F.lit(400), F.least((base * (1 + 0.5 * target_words / 8000)).cast("int"), (cap * 0.3).cast("int")))


def float_list(c: Column) -> Column:
    """Numbers of an array of strings; none at all if one of them isn't a number."""
    made = F.transform(c, lambda x: x.try_cast("double"))
    return F.when(c.isNull() | F.exists(made, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(made)
