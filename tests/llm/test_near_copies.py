"""The pipeline's near copies against all pairs in Python: what SimHash's links and similar sets connect."""

import pytest

import corpus_pipeline
from textloom.llm import near_copies, simhash

from .test_ops import brute_components, docs


def brute(rows):
    """The smallest doc_id of each group that both relations connect."""
    low = brute_components([(d, simhash.fingerprint((t or "").encode())) for d, t in rows])
    find = lambda d: d if low[d] == d else find(low[d])
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                low[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in sets if find(d) == d}


@pytest.mark.parametrize("longest", [64, 3])
def test_all_near_copies(spark, monkeypatch, longest):
    """Copies at more than two bits go too, with lists short and long."""
    monkeypatch.setattr(near_copies, "LIST", longest)
    monkeypatch.setattr(near_copies, "FREQUENT", 1)
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rows = [(r.doc_id, r.text) for r in found.select("doc_id", "text").collect()] + [(1000, None), (1001, " ")]
    base = [f"w{k}" for k in range(60)]
    rows += [(1100 + k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(12)]
    rows += [(1200 + k, " ".join([*base[:20], *(f"u{k}_{n}" for n in range(12))])) for k in range(12)]
    stage = corpus_pipeline.near_copies(spark, docs(spark, rows), "")
    assert {r.doc_id for r in stage.collect()} == brute(rows)
