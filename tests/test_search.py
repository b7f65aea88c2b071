"""Vectors of texts whose tokens are more than a task remembers."""

import numpy as np

from textloom.operators import search


def test_slots_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(search, "REMEMBERED", 3, raising=False)
    texts = [["a", "b", "c"], ["d", "e", "a"], ["a", "f", "b", "g", "a"]]
    for full in ({}, {"a": search.hash_slots(["a"], 64, {}).argmax()} | {str(k): 0 for k in range(500_001)}):
        for t in texts:
            assert np.array_equal(search.hash_slots(t, 64, full), search.hash_slots(t, 64, {}))


def test_hierarchical_embeds_what_it_looks_at(spark):
    """Vectors were made of all chunks, for summaries, routed chunks, their names and the queries that are left, again and again."""
    rows = [(d, c, f"{d}:{c}", f"word{d} topic{d % 7} piece{c} " * 3) for d in range(60) for c in range(9)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index int, chunk_id string, content string").repartition(4)
    asked = search.embedded(spark.createDataFrame([(1, "word5 topic5"), (2, "word33"), (3, "topic2 piece4")], "query_id long, query string"), "query")
    made = spark.sparkContext.accumulator(0)

    def embed(df):
        def counted(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return search.embedded(df.mapInArrow(counted, df.schema), "content")

    plain = search.hierarchical(embed(chunks), embed(chunks).where("chunk_index = 0"), asked, 8)
    want = sorted(map(tuple, plain.select("query_id", "rank", "chunk_id", "score", "doc_id").collect()))
    made.value = 0
    found = search.hierarchical(chunks, chunks.where("chunk_index = 0"), asked, 8, embed=embed)
    assert sorted(map(tuple, found.select("query_id", "rank", "chunk_id", "score", "doc_id").collect())) == want
    assert len(want) == 24 and 60 < made.value <= 60 + 3 * 3 * 9  # 60 summaries, the chunks of three documents a query
    # of a document without summary nothing is found, and a query without any document searches all
    none = search.hierarchical(chunks, chunks.where("chunk_index = 99"), asked, 8, embed=embed)
    flat = search.vector_search(search.embedded(chunks, "content"), asked, 8)
    assert sorted(map(tuple, none.select("query_id", "chunk_id", "score").collect())) == sorted(map(tuple, flat.select("query_id", "chunk_id", "score").collect()))
