"""Running sums over groups that lie in several tasks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import records, scan, tabular


def test_running_like_a_window(spark):
    r = random.Random(2)
    rows = [(None if g == 3 else g, k, r.choice([None, r.randint(-5, 9)]), str(k), k) for k, g in enumerate(r.choices([0, 0, 0, 1, 2, 3], k=900))]
    df = spark.createDataFrame(rows, "g int, k int, v int, part string, at int").repartition(3)
    out = scan.running(df, ["g"], ["k"], {"total": F.col("v"), "place": F.lit(1)}, 7)
    assert out.columns == [*df.columns, "total", "place"]
    w = Window.partitionBy("g").orderBy("k")
    want = df.withColumns({"total": F.coalesce(F.sum("v").over(w), F.lit(0)), "place": F.sum(F.lit(1)).over(w)})
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert scan.running(df.limit(0), ["g"], ["k"], {"place": F.lit(1)}).count() == 0


def test_a_large_group_is_split(spark, monkeypatch):
    seen = []
    plain = scan.written
    monkeypatch.setattr(scan, "written", lambda df: seen.append(plain(df)) or seen[-1])
    df = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.col("id").cast("double").alias("v"))
    row = tabular.trend(df, ["g"], "o", "v").first()
    assert (row.g, row.trend) == (1, "up")
    per_task = [n for n in seen[0].rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) > 2 and max(per_task) < 2000


def test_digest_of_null_and_many_lines(spark):
    rows = [("a", k, "x" * 100) for k in range(40)] + [("b", 0, None), ("b", 1, "y" * 9000), (None, 5, "z")]
    out = records.digest(spark.createDataFrame(rows, "s string, k int, line string"), ["s"], ["k"])
    assert sorted((r.s or "", r.k, r.used) for r in out.collect()) == [("", 5, 1), *(("a", k, 100 * (k + 1)) for k in range(35)), ("b", 0, 0), ("b", 1, 1750)]
