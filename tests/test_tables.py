"""Tables that are changed by keys against a dictionary."""

import os
import random

from textloom.sources.tables import KeyedTable

SCHEMA = "doc string, chunk int, text string, at long"


def size(path):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_batches_like_a_dictionary(spark, tmp_path):
    r = random.Random(4)
    path = str(tmp_path / "t")
    table, want = KeyedTable(spark, path, SCHEMA, ["doc", "chunk"], 4), {}
    assert table.read().count() == 0 and table.compact() == []
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for step in range(9):
        kind = step if step < 4 else r.randrange(4)
        if kind in (0, 1):
            rows = [(r.choice(["a", "b", "c", None]), r.randrange(6), f"{step}-{k}", k) for k in range(20)]
            table.upsert(frame(rows), "at")
            want |= {(d, c): (x, a) for d, c, x, a in rows}
        elif kind == 2:
            gone = [(r.choice("ab"), r.randrange(6)) for _ in range(4)]
            table.delete(spark.createDataFrame(gone, "doc string, chunk int"))
            want = {k: v for k, v in want.items() if k not in gone}
        elif step % 2:
            table.delete(spark.createDataFrame([("c",)], "doc string"))
            want = {k: v for k, v in want.items() if k[0] != "c"}
        else:
            table.update(spark.createDataFrame([("a", k, "set") for k in range(9)], "doc string, chunk int, text string"), ["text"])
            want = {k: ("set", v[1]) if k[0] == "a" else v for k, v in want.items()}
        if step in (2, 6):
            assert table.compact(2)
        got = {(x.doc, x.chunk): (x.text, x.at) for x in table.read().collect()}
        assert got == want, step
    assert KeyedTable(spark, path, SCHEMA, ["doc", "chunk"], 4).read().count() == len(want)


def test_a_batch_costs_its_rows_and_broken_writes_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "k long, text string", ["k"], 4)
    table.upsert(spark.range(20_000).selectExpr("id AS k", "sha2(cast(id AS string), 256) AS text"))
    table.compact()
    before = size(path)
    table.upsert(spark.createDataFrame([(7, "new"), (20_001, "more")], "k long, text string"))
    assert size(path) - before < 0.01 * before
    spark.createDataFrame([(9, "lost", False, 1)], "k long, text string, gone__ boolean, bucket__ int").write.partitionBy("bucket__").parquet(f"{path}/changes/seq__=99")  # a job that died before its mark
    got = {r.k: r.text for r in table.read().where("k IN (7, 9, 20001)").collect()}
    assert got[7] == "new" and got[20_001] == "more" and got[9] != "lost" and table.read().count() == 20_001
    assert set(table.compact()) == {0, 1, 2, 3} and table.read().count() == 20_001
