"""Spreadsheet analytics over numeric columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running

BINS = 4096  # of a pass that narrows the place of a median
FEW = 65_536  # values in a bin from which on they are looked at one by one


def melted(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value of every numeric cell, in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")


def order_statistics(df: DataFrame, wanted: dict[str, tuple[float, float, list[int]]]) -> dict[str, list[float]]:
    """Values at given ranks (from 0) of columns with their low and high: {column: (low, high, ranks)}.

    Each pass counts the values of all open ranges in BINS bins; a range shrinks to the bin of its rank until few distinct
    values are left in it, which are then counted. Counts are all that is shuffled or sent to the driver.
    """
    open_ = {(c, r): (lo, hi, r) for c, (lo, hi, ranks) in wanted.items() for r in ranks}
    found: dict[tuple[str, int], float] = {}
    while open_:
        names = list(dict.fromkeys((c, lo, hi) for (c, _), (lo, hi, _) in open_.items()))
        cell = lambda at, c, lo, hi: F.when(F.col(c).cast("double").between(lo, hi), F.struct(F.lit(at).alias("at"), F.least(F.lit(BINS - 1), F.floor((F.col(c).cast("double") - lo) / (max(hi - lo, 5e-324) / BINS))).cast("int").alias("bin"), F.col(c).cast("double").alias("v")))
        rows = df.select(F.explode(F.array_compact(F.array(*[cell(at, *x) for at, x in enumerate(names)]))).alias("x")).select("x.*")
        bins: dict[int, list] = {}
        for r in rows.groupBy("at", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():  # BINS rows for each open range
            bins.setdefault(r.at, []).append((r.bin, r.n, r.lo, r.hi))
        small: dict[tuple[str, int], tuple[float, float, int]] = {}
        for (c, rank), (lo, hi, left) in list(open_.items()):
            for _, n, low, high in sorted(bins[names.index((c, lo, hi))]):
                if left < n:
                    break
                left -= n
            del open_[c, rank]
            if low == high:
                found[c, rank] = low
            elif n <= FEW or (low, high) == (lo, hi):
                small[c, rank] = (low, high, left)
            else:
                open_[c, rank] = (low, high, left)
        for (c, rank), (low, high, left) in small.items():
            values = df.select(F.col(c).cast("double").alias("v")).where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v")
            for r in values.toLocalIterator():
                if left < r.n:
                    found[c, rank] = r.v
                    break
                left -= r.n
    return {c: [found[c, r] for r in ranks] for c, (_, _, ranks) in wanted.items()}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, n, mean, median, sd, low, high, rounded to two digits: one aggregate over all columns, medians by counting."""
    v = lambda c: F.col(c).cast("double")
    row = df.agg(*[x for c in columns for x in (F.count(c).alias(f"n {c}"), F.avg(v(c)).alias(f"mean {c}"), F.stddev_samp(v(c)).alias(f"sd {c}"), F.min(v(c)).alias(f"low {c}"), F.max(v(c)).alias(f"high {c}"))]).first()
    full = [c for c in columns if row[f"n {c}"]]
    middle = order_statistics(df, {c: (row[f"low {c}"], row[f"high {c}"], sorted({(row[f"n {c}"] - 1) // 2, row[f"n {c}"] // 2})) for c in full})
    rows = [(c, row[f"n {c}"], row[f"mean {c}"], sum(middle[c]) / len(middle[c]), row[f"sd {c}"], row[f"low {c}"], row[f"high {c}"]) for c in full]
    out = df.sparkSession.createDataFrame(rows, "name string, n long, mean double, median double, sd double, low double, high double")
    return out.select("name", "n", *[F.round(c, 2).alias(c) for c in ("mean", "median", "sd")], "low", "high")


def trend(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Mean of the first half of each group's rows against the second: up over 1.05 times, down under 0.95; groups of 3 or more.
    A group is counted through over several tasks, and its halves are aggregates; nothing needs it in one place."""
    named = df.select(*(F.col(b).alias(f"by_{k}") for k, b in enumerate(by)), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    groups = [f"by_{k}" for k in range(len(by))]
    sizes = named.groupBy(*groups).agg(F.count("*").alias("n")).where("n >= 3").select(*(F.col(g).alias(f"of_{g}") for g in groups), "n")
    placed = running(named, groups, ["order", "value"], {"place": F.lit(1)})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    first = F.col("place") <= F.floor(F.col("n") / 2)
    out = placed.join(sizes, same).groupBy(*groups).agg(F.avg(F.when(first, F.col("value"))).alias("a"), F.avg(F.when(~first, F.col("value"))).alias("b"))
    kind = F.when(F.col("b") > F.col("a") * 1.05, "up").when(F.col("b") < F.col("a") * 0.95, "down").otherwise("flat")
    return out.select(*(F.col(g).alias(b) for g, b in zip(groups, by, strict=True)), kind.alias("trend"), F.round(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(0.01)) * 100, 2).alias("pct"))


def correlations(df: DataFrame, columns: list[str], least: float = 0.3) -> DataFrame:
    """anchor, name, r: Pearson's r of columns with the one of the highest variance, where |r| is over `least`."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    anchor = max(columns, key=lambda c: (row[c] or 0.0, c))
    rows = df.agg(*[F.corr(anchor, c).alias(c) for c in columns if c != anchor])
    out = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("r")) for c in columns if c != anchor])).alias("x"))
    return out.select(F.lit(anchor).alias("anchor"), "x.name", F.round("x.r", 6).alias("r")).where(F.abs("r") > least)


def extremes(df: DataFrame, key: str, columns: list[str], k: int = 3) -> DataFrame:
    """name, side, rank, key, value: the k highest and lowest of each column; each is a bounded top-k, not a sort."""
    parts = []
    for c in columns:
        for side, order in (("top", F.desc(c)), ("bottom", F.asc(c))):
            best = df.where(F.col(c).isNotNull()).orderBy(order, key).limit(k)
            rank = F.row_number().over(Window.orderBy(order, key))
            parts.append(best.select(F.lit(c).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), F.col(key).alias("key"), F.col(c).cast("double").alias("value")))
    return reduce(DataFrame.union, parts)


def top_and_others(df: DataFrame, label: str, value: str, k: int = 7, others: str = "其他") -> DataFrame:
    """label, value: sums of the k largest labels, and of all others together."""
    sums = df.groupBy(F.col(label).alias("label")).agg(F.sum(F.col(value).cast("decimal(38,2)")).alias("value"))
    best = sums.orderBy(F.desc("value"), "label").limit(k).select(F.col("label").alias("best"))
    named = sums.join(F.broadcast(best), F.col("label") == F.col("best"), "left")
    return named.groupBy(F.coalesce("best", F.lit(others)).alias("label")).agg(F.sum("value").cast("double").alias("value"))
