"""The pipeline against its stages run by hand on Python values."""

import corpus_pipeline

from ..conftest import SF
from .test_near_copies import brute
from .test_ops import brute_substrings


def test_pipeline(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    docs = rows
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append((name, docs))
        if name != "best_fit_packing":
            assert docs.columns == rows.columns
    made = dict(seen)
    before = [(r.doc_id, r.text) for r in made["language_id"].collect()]
    assert sorted(d for d, _ in before) == sorted(r.doc_id for r in rows.collect())  # all of these are in a known language
    owner, kept = {}, {}
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for d, t in before:
        for line in t.split("\n"):
            owner[key(line)] = min(owner.get(key(line), d), d)
    for d, t in before:
        kept[d] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] >= d)
    assert {r.doc_id: r.text for r in made["line_dedup"].collect()} == kept
    stay = brute(list(kept.items()))
    assert {r.doc_id for r in made["near_dedup"].collect()} == stay
    want = brute_substrings([(d, kept[d]) for d in stay])
    assert {r.doc_id: " ".join(r.text.split()) for r in made["substring_dedup"].collect()} == {d: x[2] for d, x in want.items()}
    assert {r.doc_id for r in made["best_fit_packing"].select("doc_id").distinct().collect()} == stay
    assert corpus_pipeline.run(spark, SF).count() == made["best_fit_packing"].count()
