"""Best fuzzy matches against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from textloom.operators import fuzzy, matching
from textloom.plans import catalog, load

from .conftest import SF

load()


def brute(keys, names, least, bonus=0.3, whole=None):
    out = {}
    for group, key in set(keys):
        best = (-1.0, None, None)
        for g, pos, name in sorted(names):
            if g == group:
                held = key in name or name in key
                own = whole if held and whole is not None else round(SequenceMatcher(None, key, name).ratio() + bonus * held, 6)
                if own > best[0]:
                    best = (own, pos, name)
        out[group, key] = (best[2], best[0]) if best[0] >= least else (None, None)
    return out


def made(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdeéft 漢字", k=r.randint(1, 14))) for _ in range(n)]
    return base + ["".join(c for c in s if r.random() > 0.2) for s in base] + [s + "xy" for s in base[:9]] + ["", "q"]


@pytest.mark.parametrize("few", [256, 3])
def test_all_pairs_of_a_group(spark, monkeypatch, few):
    monkeypatch.setattr(fuzzy, "FEW", few)
    keys = [(k % 3, s) for k, s in enumerate(made(1, 25))]
    names = [(k % 4 if k % 5 else 1, k, s) for k, s in enumerate(made(2, 40) + made(1, 12))]
    left, right = spark.createDataFrame(keys, "g int, key string"), spark.createDataFrame(names, "g int, pos int, heading string")
    found = {(r.g, r.key): (r.heading, r.score) for r in matching.best_headings(left, right, ["g"]).collect()}
    assert found == brute(keys, names, 0.35)
    cites = left.withColumnRenamed("key", "cite")
    got = {(r.g, r.cite): r.score for r in matching.match_sources(cites, right.withColumnRenamed("heading", "source"), ["g"]).collect()}
    assert got == {k: s for k, (_, s) in brute(keys, names, 0.35, whole=1.0).items()}


def test_words_of_a_citation(spark):
    cites = spark.createDataFrame([(1, "zz report、of the year"), (1, "annual"), (1, "qqqq"), (2, "alone")], "t int, cite string")
    sources = spark.createDataFrame([(1, 0, "long name of some annual report.pdf"), (1, 1, "zq xeport of tge zear.pdf")], "t int, pos int, source string")
    found = {r.cite: (r.source, r.score) for r in matching.match_sources(cites, sources, ["t"]).collect()}
    assert found["annual"] == ("long name of some annual report.pdf", 1.0) and found["qqqq"] == (None, None) and found["alone"] == (None, None)
    ratio = max(SequenceMatcher(None, "zz report、of the year", s).ratio() for s in ("long name of some annual report.pdf", "zq xeport of tge zear.pdf"))
    assert found["zz report、of the year"][1] == round(ratio, 6)


def test_table_without_groups(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_type", "p_name").collect()
    want = brute([(0, r.p_type) for r in part], [(0, r.p_partkey, r.p_name) for r in part], 0.35)
    rows = catalog.QUERIES["fuzzy_names"](spark, SF).collect()
    assert {(0, r.key): (r["name"], r.score) for r in rows} == want
    assert sum(r.scored or 0 for r in rows) < 0.35 * len({r.p_type for r in part}) * len({r.p_name for r in part})


def test_bounds():
    strings = made(5, 40)
    found = fuzzy.bounds(fuzzy.counts(strings), fuzzy.counts(strings))
    real = np.array([[SequenceMatcher(None, a, b).ratio() for b in strings] for a in strings])
    assert (found >= real - 1e-9).all()
