"""Near duplicates against brute force."""

import pathlib
import random

import pytest

from textloom.functions import text as X
from textloom.operators import records, similar


@pytest.mark.parametrize("sampled", [1, 1 << 40])
def test_no_pair_is_lost(spark, monkeypatch, sampled):
    """Near copies, chains, texts of one set and texts without tokens, with frequent tokens last and by hash alone."""
    monkeypatch.setattr(similar, "SAMPLED", sampled)
    monkeypatch.setattr(similar, "FREQUENT", 1)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäя漢", k=rng.randint(2, 9))) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "ab"), (3, "A b"), (4, "...")]
    while len(rows) < 120:
        base = rng.choices(words, k=rng.randint(8, 160))
        for _ in range(rng.randint(1, 5)):
            rows.append((len(rows), " ".join(base)))
            for at in rng.sample(range(len(base)), max(1, len(base) // 20)):
                base[at] = rng.choice(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r[0]: set(r[1]) for r in docs.select("doc_id", X.similarity_tokens(X.text("text"))).collect()}
    want, kept = {}, []
    for d, g in sorted(sets.items()):
        want[d] = next((k for k in kept if len(g & sets[k]) >= 0.75 * len(g | sets[k])), d)
        kept += [d] * (want[d] == d)
    assert 20 < sum(k != v for k, v in want.items()) < 110
    assert {r.key: r.kept_key for r in records.near_duplicates(docs, "text", "doc_id").collect()} == want


def test_what_is_written_is_less_than_the_texts(spark):
    """Token sets were written as plain rows, which took more than their texts do."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(3000)]
    rows = [(k, " ".join(rng.choices(words, k=600))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = pathlib.Path(similar.folder(spark, "x").removeprefix("file:")).parent
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before = size()
    assert similar.pairs(docs, "text", "doc_id", 0.75)[0].count() == 0
    assert 0 < size() - before < sum(len(t) for _, t in rows)


def moved(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sets_are_not_moved_for_each_pair(spark):
    """Each pair took both of its sets through a shuffle."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(4000)]  # a row is longer than what compression looks back
    rows = [(k, " ".join(words[:k] + words[k + 1 :])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before, sent = moved(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many rows
    try:
        assert similar.pairs(docs, "text", "doc_id", 0.75)[0].count() == 40 * 39 / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert moved(spark) - before < 4 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_blocks_and_lengths_of_sketches(spark, monkeypatch, seed):
    """Sizes from one token to a thousand, in small blocks and parts of one size, pairs dealt out."""
    for name, value in (("LEAST", 8), ("BLOCKS", 1000), ("SAMPLED", 2), ("FREQUENT", 2), ("PAIRS", 20), ("HELD", 1), ("ROWS", 3)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(1500)]
    rows = [(k, rng.choice(words)) for k in range(30)] + [(30 + k, " ".join(rng.sample(words[:12], 9))) for k in range(80)]
    while len(rows) < 260:
        base = rng.sample(words, rng.choice([3, 40, 43, 60, 85, 90, 400, 690, 1000]))
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(base)))
            base = rng.sample(base, len(base) - rng.randint(0, len(base) // 6)) + rng.sample(words, rng.randint(0, len(base) // 12))
    sets = {}
    for k, s in rows:
        sets.setdefault(frozenset(s.split()), k)
    nodes = [(k, g) for g, k in sets.items()]
    want = {(a, b) for a, g in nodes for b, h in nodes if a < b and len(g & h) >= 0.75 * len(g | h)}
    found = [tuple(r) for r in similar.pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", "doc_id", 0.75)[0].collect()]
    assert len(found) == len(want) > 300 and set(found) == want
