"""Spelling variants against a comparison of all words, letter by letter."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import variants as v
from textloom.llm.common import Scratch

from ..conftest import SF

SCHEMA = "doc_id long, text string, word string, n int, id string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, pairs=near):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    close = {w: [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(size, ()) if x != w and pairs(w, x)] for w in words}
    form = {}
    for w, k in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * k else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), k, len(close[w]), words[form[w]] if form[w] else None) for w, k in words.items())


def found(spark, rows):
    df = v.spelling_variants(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = sorted(map(tuple, v.query(spark, SF).collect()))

    def pairs(a, b):  # cheap first
        return len(set(a) ^ set(b)) <= 2 and near(a, b)

    assert out == brute(docs, pairs) and any(r[1] for r in out) and any(r[2] != r[1] and r[1] for r in out) is any(r[2] != r[1] and r[1] for r in brute(docs, pairs))


def test_made_words(spark):
    r = random.Random(8)
    rows, doc = [], 0
    for base in ("aaaaaa", "banana", "Straße", "übergrößen", "mississippi", "×÷ÿÀéñ", "abcdefabcdef"):
        for _ in range(60):
            word, times = list(base), r.choice([1, 5, 6, 30, 200])
            for _ in range(r.choice([0, 1, 1, 2])):
                at = r.randrange(len(word))
                word[at : at + r.choice([0, 1])] = r.choice(["", "a", "b", "é", "n", word[at]])
            rows.append((doc, " ".join(["".join(word)] * times)))
            doc += 1
    rows += [(1, rows[1][1])] * 3 + [(None, "nulldoc " * 9 + "nulldocs"), (doc, None), (doc + 1, ""), (doc + 2, "12345 ...\x00"), (doc + 3, "日本語banana日本語")]
    assert found(spark, rows) == brute(rows)


def test_chains_long_words_and_no_rows(spark):
    chain = [(k, " ".join(["abcdefg" + "h" * k] * 6 * 5**k)) for k in range(4)]  # each the form of the one before
    text = "x" * 30_000
    long = [(100 + k, " ".join([w] * n)) for k, (w, n) in enumerate([(text, 5), (text + "x", 6), ("y" + text[1:], 30), (text[:-9] + "z" + text[-9:], 25)])]
    out = {r[0]: r for r in found(spark, chain + long)}
    at = sorted((r for w, r in out.items() if len(w) < 99), key=lambda r: len(r[0]))
    assert [r[2] for r in at] == [at[-1][0]] * len(at) and [r[1] for r in at] == [r[0] for r in at[1:]] + [None]
    assert [out[w][4] for w in (text, text + "x", "y" + text[1:])] == [3, 2, 1]
    assert out[text][1] == "y" + text[1:] and out[text][5] == 30 and out[text + "x"][1] is None
    assert found(spark, []) == []
    assert found(spark, [(1, "once only words here"), (2, None)]) == []


@pytest.mark.parametrize("n", [1, 2, 6, 33])
def test_hashes_of_deletions(n):
    r = np.random.default_rng(n)
    points = r.integers(97, 300, (50, n)).astype(np.uint32)
    whole, less = v.hashes(points)
    for k in range(n):
        rest = np.delete(points, k, axis=1)
        assert (less[:, k] == (v.hashes(rest)[0] if n > 1 else 0)).all()
    assert len(np.unique(whole)) == len(np.unique(points, axis=0))


def test_collisions_link_nothing(spark):
    words = [("banana", 9), ("banane", 50), ("bananas", 6), ("ananas", 7), ("cabana", 8), ("planet", 60), ("planets", 5)]
    df = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(words)], "id long, word string, n long")
    plain = sorted(map(tuple, v.near_words(df, Scratch(spark, "plain")).collect()))
    rows = []
    for place in (v.WHOLE, v.DELETED, 0, 3):  # one key for everything
        rows += [(7, place, k, w, n) for k, (w, n) in enumerate(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(rows), strict=True)], names=["key", "place", "id", "word", "n"])
    got = {(r["id"], r["word"]) for b in v._judged(iter([batch])) for r in b.to_pylist()}
    texts = dict(enumerate(w for w, _ in words))
    assert got and all(near(texts[i], w) for i, w in got) and [r[0] for r in plain] == [0, 1, 2, 3, 5, 6]
