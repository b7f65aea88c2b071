"""Search over cells against all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cells, search


def clustered(seed, n, size=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, size))
    return np.round(centres[r.integers(0, 9, n)] + 0.15 * r.normal(size=(n, size)), 3)


@pytest.mark.parametrize("k", [1, 7])
def test_like_all_vectors_and_most_are_skipped(spark, k):
    x = clustered(1, 900)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[5].tolist()) for i in range(12)] + [(3000, [0.0] * 12), (3001, None), (3002, []), (3003, [None] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [(i, v.tolist()) for i, v in enumerate(clustered(2, 20))] + [(50, x[5].tolist()), (51, [0.0] * 12), (52, (-x[3]).tolist()), (53, None)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    table = cells.CellTable(vectors, "vec_id", 60)
    usable = vectors.where("vec_id not in (3001, 3002, 3003)")
    assert sorted(map(tuple, table.search(queries, k).collect())) == sorted(map(tuple, search.vector_search(usable, queries, k, key="vec_id").collect()))
    scored = {r.query_id: r.score for r in table._search(queries, k, 6).where(F.col("vec_id").isNull()).collect()}
    near = [scored[q] for q in range(20)]
    assert sum(near) < 0.6 * 20 * 913 and scored[51] == 913  # a query without length has to look at all


def test_no_vectors_and_no_queries(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    ask = some.select(F.col("vec_id").alias("query_id"), "embedding")
    assert cells.CellTable(none, "vec_id").search(ask, 3).count() == 0
    assert cells.CellTable(some, "vec_id").search(ask.limit(0), 3).count() == 0
    assert cells.CellTable(spark.createDataFrame([(4, [0.0, 0.0])], "vec_id long, embedding array<double>"), "vec_id").search(ask, 3).collect()[0].score == 0.0
