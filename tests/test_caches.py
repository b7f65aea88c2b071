"""Result caches and JSON columns."""

from pyspark.sql import functions as F

from textloom.sources import files


def test_cache_makes_each_input_once_and_forgets(spark, tmp_path):
    cache, asked = files.ResultCache(spark, str(tmp_path / "c"), days=10), []

    def make(new):
        asked.append(sorted(r.input for r in new.collect()))
        return new.select("md5", F.concat(F.lit("made "), "input").alias("value"))

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("", 5)], "t string, md5 int")
    out, n = cache.get(rows, "t", make, 100)
    assert n == 3 and out.columns == ["t", "md5", "value"]
    assert sorted((r.md5, r["value"]) for r in out.collect()) == [(1, "made a"), (2, "made b"), (3, "made a"), (4, None), (5, "made ")]
    assert cache.get(rows, "t", make, 105)[1] == 0
    assert cache.get(rows.unionByName(spark.createDataFrame([("c", 9)], "t string, md5 int")), "t", make, 108)[1] == 1
    assert asked == [["", "a", "b"], ["c"]]
    assert cache.get(rows.where("t = 'a'"), "t", make, 110)[1] == 1  # ten days old: made anew
    assert cache.evict(110) == [100] and cache.evict(110) == []
    assert cache.table(110).count() == 2 and files.ResultCache(spark, str(tmp_path / "none")).evict(5) == []
    assert cache.get(rows.limit(0), "t", make, 111)[1] == 0


def test_json_columns(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x", "n": {"k": [1]}}',), ("{",), (None,), ('{"a": null}',), ("[1]",)], "j string")
    got = [tuple(r) for r in files.read_json_column(rows.withColumn("j_parsed", F.lit(0)), "j", ["a", "b", "n"]).select("a", "b", "n").collect()]
    assert got == [("1", "x", '{"k":[1]}'), (None, None, None), (None, None, None), (None, None, None), (None, None, None)]
