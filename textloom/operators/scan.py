"""Running sums in two passes, so that a group need not lie in one task.

Rows are dealt by ranges of (group, order), so a large group covers several tasks. Each task sums its own rows from its start; a
row for each task and group says what lies before it, and is added. What is shuffled beside the rows is a sum for each task and
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similar import written


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def running(rows: DataFrame, by: list[str], order: list, sums: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """rows with columns of running sums (a row's own value included) within `by`, in `order`, which has to be total for a
    definite result. Nulls of `by` are one group, null values count nothing."""
    spark = rows.sparkSession
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, *rest = fresh_names(rows, "part", *(f"v_{k}" for k in range(len(sums))), *(f"by_{k}" for k in range(len(by))), "at", *(f"before_{k}" for k in range(len(sums))))
    own, groups, at, before = rest[: len(sums)], rest[len(sums) : len(sums) + len(by)], rest[len(sums) + len(by)], rest[len(sums) + len(by) + 1 :]
    valued = rows.withColumns({v: c for v, c in zip(own, sums.values(), strict=True)})
    dealt = written(valued.repartitionByRange(n, *by, *order).withColumn(part, F.spark_partition_id()))
    inner = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy(*groups).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*(F.col(b).alias(g) for b, g in zip(by, groups, strict=True)), F.col(part).alias(at)).agg(*(F.sum(v).alias(b) for v, b in zip(own, before, strict=True)))
    totals = totals.select(*groups, at, *(F.coalesce(F.sum(b).over(behind), F.lit(0)).alias(b) for b in before))
    same = F.col(part) == F.col(at)
    for b, g in zip(by, groups, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(g))
    local = dealt.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"{v}s") for v in own))
    out = local.join(totals, same)
    return out.select(*rows.columns, *((F.col(f"{v}s") + F.col(b)).alias(name) for name, v, b in zip(sums, own, before, strict=True)))
