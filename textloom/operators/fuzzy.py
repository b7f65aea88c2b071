"""Best fuzzy match of each key among many names, by an index on character multisets.

The ratio of matching blocks is 2M / (n + m), and M is at most what the two multisets of characters have in common. So a
ratio of `t` needs an overlap of t(n + m) / 2, which is n * t / (2 - t) at least. With occurrences of characters (the second e,
...) as elements, rare ones first, two such strings share one of their first n - that + 1 elements: an equi-join of
prefixes has all candidates, and the counts of their characters bound the ratio before any block is matched.

A key is settled by that join, whose prefixes are short, if its best score is one that no pair of a smaller ratio than `SURE`
can reach. What is left is a stated set of queries: where a group has few names they go with each of its keys, elsewhere
blocks of keys meet every name. Bounds for all of these are sums of minima over character counts, and ratios are taken
from the highest bound down until no bound can win. A task hands on one row a key. Names are compared once, however often they
occur, and ties go to the smallest position.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.text import text
from .search import in_blocks
from .similar import written

SURE = 0.8  # a key with such a match needs no other round
FEW = 256  # names of a group that go with each of its keys
NAMES = 2048  # names compared at once
SLOTS = 64  # counts of characters; those that share a slot only raise a bound
DIGITS = 6


def counts(strings: list[str]) -> np.ndarray:
    """Character counts, a row each, in SLOTS columns."""
    out = np.zeros((len(strings), SLOTS), np.int32)
    for k, s in enumerate(strings):
        if s:
            out[k] = np.bincount(np.frombuffer(s.encode("utf-32-le"), "<u4") % SLOTS, minlength=SLOTS)
    return out


def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of count rows a and b: what the ratio of each pair is at most."""
    total = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :]
    both = np.zeros(total.shape, np.int32)
    for c in range(SLOTS):
        if a[:, c].any() and b[:, c].any():
            both += np.minimum(a[:, c][:, None], b[:, c][None, :])
    return np.where(total > 0, 2.0 * both / np.maximum(total, 1), 1.0)


class Score:
    """ratio + `bonus` where one string holds the other, or `whole` there instead; words: a name that holds a word of a key with no better score than `weak` wins."""

    def __init__(self, bonus: float = 0.0, whole: float | None = None, weak: float | None = None):
        self.bonus, self.whole, self.weak = bonus, whole, weak

    def of(self, key: str, name: str, holds: bool) -> float:
        if holds and self.whole is not None:
            return self.whole
        return round(SequenceMatcher(None, key, name).ratio() + self.bonus * holds, DIGITS)


def holds(key: str, name: str) -> bool:
    return key in name or name in key


def words(key: str) -> list[str]:
    """The words of a citation by which a source may be found."""
    return [w for w in key.replace("、", " ").replace("，", " ").split() if len(w) >= 2]


class Best:
    """The best name of a key so far."""

    __slots__ = ("score", "pos", "name", "scored", "word_pos", "word_name")

    def __init__(self):
        self.score, self.pos, self.name, self.scored, self.word_pos, self.word_name = -1.0, None, None, 0, None, None

    def take(self, key: str, names: list[str], at: list, bound: np.ndarray, score: Score, least: float, word: list[str]) -> None:
        """Names with their positions and the bounds of their ratios."""
        held = np.fromiter((holds(key, n) for n in names), bool, len(names))
        most = np.where(held, score.whole, bound) if score.whole is not None else bound + score.bonus * held
        for k in np.argsort(-most, kind="stable"):
            if most[k] + 1e-6 < max(least, self.score):
                break
            own = score.of(key, names[k], bool(held[k]))
            self.scored += 1
            if own > self.score or own == self.score and at[k] < self.pos:
                self.score, self.pos, self.name = own, at[k], names[k]
        if word and self.score < score.weak:
            for n, p in zip(names, at, strict=True):
                if (self.word_pos is None or p < self.word_pos) and any(w in n for w in word):
                    self.word_pos, self.word_name = p, n


def _elements(df: DataFrame, column: str) -> DataFrame:
    """df with `e`, a row for each element of its string: the character and its occurrence; and `n`, the string's length."""
    chars = F.filter(F.split(F.col(column), ""), lambda c: c != "")
    seen = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))
    return df.withColumn("n", F.length(column)).withColumn("e", F.explode(seen))


def _prefixes(df: DataFrame, column: str, by: list[str], rare: DataFrame, t: float) -> DataFrame:
    """by, column, its length, e: the rare-first elements of which strings of ratio t share one."""
    ranked = _elements(df, column).join(rare, "e").withColumn("r", F.row_number().over(Window.partitionBy(*by, column).orderBy("k", "e")))
    return ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * t / (2 - t) - 1e-9) + 1).select(*by, column, F.col("n").alias(f"n_{column}"), "e")


def _judge(score: Score, sure: float):
    """The scores of pairs that bounds don't rule out."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = counts(list(a)), counts(list(b))
        bound = 2.0 * np.minimum(x, y).sum(axis=1) / np.maximum(x.sum(axis=1) + y.sum(axis=1), 1)
        return pd.Series([score.of(p, q, holds(p, q)) if u >= sure - 1e-6 else None for p, q, u in zip(a, b, bound, strict=True)], dtype="float64")

    return run


def _found(best: Best) -> list:
    return [best.name, best.pos, best.score, best.scored, best.word_name, best.word_pos]


def _within(by: list[str], key: str, score: Score, least: float, schema: pa.Schema) -> Callable:
    """Rows (by, key, names array of (name, pos)): the best of each row's own names."""

    def run(batches):
        for batch in batches:
            out = []
            for *group, own, names in zip(*(batch.column(c).to_pylist() for c in [*by, key, "names"]), strict=True):
                strings, best = [n["name"] for n in names], Best()
                best.take(own, strings, [n["pos"] for n in names], bounds(counts([own]), counts(strings))[0], score, least, words(own) if score.weak is not None else [])
                out.append([*group, own, *_found(best)])
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _block(sent, by: list[str], name: str, score: Score, least: float, schema: pa.Schema) -> Callable:
    """Names in tasks against a block of keys."""

    def run(batches):
        keys = sent.value
        have = counts([k[-1] for k in keys])
        wanted = [words(k[-1]) if score.weak is not None else [] for k in keys]
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            groups.setdefault(tuple(k[:-1]), []).append(i)
        best: dict[int, Best] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, NAMES):
                part = whole.slice(at, NAMES)
                names, pos = part.column(name).to_pylist(), part.column("pos").to_pylist()
                rows: dict[tuple, list[int]] = {}
                for r, g in enumerate(zip(*(part.column(c).to_pylist() for c in by), strict=True) if by else [()] * len(names)):
                    if g in groups:
                        rows.setdefault(g, []).append(r)
                for g, own in rows.items():
                    bound = bounds(have[groups[g]], counts([names[r] for r in own]))
                    for i, line in zip(groups[g], bound, strict=True):
                        best.setdefault(i, Best()).take(keys[i][-1], [names[r] for r in own], [pos[r] for r in own], line, score, least, wanted[i])
        out = [[*keys[i], *_found(b)] for i, b in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _settled(asked: DataFrame, there: DataFrame, key: str, name: str, by: list[str], score: Score, sure: float) -> DataFrame:
    """by, key, name, score, scored of keys with a match that no pair of a smaller ratio than `sure` can beat."""
    elements = lambda df, c: _elements(df.select(c), c).groupBy("e").agg(F.count("*").alias("k"))
    rare = written(elements(there, name).unionByName(elements(asked, key)).groupBy("e").agg(F.sum("k").alias("k")))  # a row for each character and occurrence
    a, b = f"n_{key}", f"n_{name}"
    share = 2 * F.least(a, b) / (F.col(a) + F.col(b)) >= sure - 1e-9  # by lengths alone
    pairs = _prefixes(asked, key, by, rare, sure).join(_prefixes(there, name, by, rare, sure), [*by, "e"]).where(share).select(*by, key, name).distinct()
    judged = written(pairs.join(there, [*by, name]).withColumn("score", _judge(score, sure)(key, name)))
    own = Window.partitionBy(*by, key)
    first = judged.withColumn("scored", F.count("score").over(own)).withColumn("rn", F.row_number().over(own.orderBy(F.desc_nulls_last("score"), "pos")))
    return first.where((F.col("rn") == 1) & (F.col("score") >= sure + score.bonus)).select(*by, key, name, "score", F.col("scored").cast("long"))


def best_matches(keys: DataFrame, names: DataFrame, key: str, name: str, by: list[str], least: float, score: Score, sure: float = SURE) -> DataFrame:
    """by, key, name, score, scored for each distinct key: its best name of the same `by`, null under `least`, and how many pairs had their blocks matched last.

    names: by, name, pos. With a weak score set, a key under it takes the first name that holds one of its words. Null
    strings are empty ones; a key without any name of its `by` has null name and score.
    """
    spark = keys.sparkSession
    asked = written(keys.select(*by, text(key).alias(key)).distinct())
    there = written(names.select(*by, text(name).alias(name), "pos").groupBy(*by, name).agg(F.min("pos").alias("pos")))
    place = there.schema["pos"].dataType
    schema = StructType(
        [*(asked.schema[c] for c in [*by, key]), StructField(name, StringType()), StructField("pos", place), StructField("score", DoubleType()), StructField("scored", LongType()), StructField("word_name", StringType()), StructField("word_pos", place)]
    )
    won = written(_settled(asked, there, key, name, by, score, sure)) if score.whole is None else None  # a name that holds the key may lie anywhere
    left = asked if won is None else asked.join(won, [*by, key], "left_anti").select(*by, key)
    found = []
    if by:  # few names: they go with each key
        sizes = written(there.groupBy(*by).agg(F.count("*").alias("size")))
        small = there.join(sizes.where(F.col("size") <= FEW), by, "left_semi").groupBy(*by).agg(F.collect_list(F.struct(F.col(name).alias("name"), "pos")).alias("names"))
        found.append(written(left.join(small, by).mapInArrow(_within(by, key, score, least, to_arrow_schema(schema)), schema)))
        left = left.join(sizes.where(F.col("size") > FEW), by, "left_semi")
    for block in in_blocks(left, left.columns):
        if block:
            sent = spark.sparkContext.broadcast([tuple(r) for r in block])
            found.append(written(there.mapInArrow(_block(sent, by, name, score, least, to_arrow_schema(schema)), schema)))
    if found:
        best = reduce(DataFrame.union, found).groupBy(*by, key).agg(
            F.min(F.struct((-F.col("score")).alias("lost"), "pos", F.col(name).alias("name"))).alias("b"), F.sum("scored").alias("scored"), F.min_by("word_name", "word_pos").alias("word_name"),
        )
        own = -F.col("b.lost")
        weak = (own < score.weak) & F.col("word_name").isNotNull() if score.weak is not None else F.lit(False)
        rest = best.where(own >= least).select(*by, key, F.when(weak, F.col("word_name")).otherwise(F.col("b.name")).alias(name), own.alias("score"), "scored")
        won = rest if won is None else won.unionByName(rest)
    return asked if won is None else asked.join(won, [*by, key], "left")
