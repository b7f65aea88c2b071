"""Edit distances against the table of all prefixes."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import edits
from textloom.functions import metrics as M
from pyspark.sql import functions as F


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé漢🦄", max_size=90), st.text("abé漢🦄", max_size=90), st.integers(0, 30))
def test_like_the_table(a, b, most):
    want = table(a, b)
    assert edits.distance(a, b) == want == edits.distance(b, a)
    cut = edits.distance(a, b, most)
    assert cut == want if want <= most else cut > most


def test_long_texts_are_cheap():
    r = random.Random(1)
    a = "".join(r.choices("abcdefgh ", k=20_000))
    b = "".join(c for c in a if r.random() > 0.05)
    start = time.process_time()
    assert edits.distance(a, b) == len(a) - len(b)
    assert edits.distance(a, "x" * 20_000, 50) > 50
    assert time.process_time() - start < 20


def test_columns(spark):
    rows = spark.createDataFrame([("Kitten ", ["sitting", None, " kitteN"]), ("", [""]), (None, ["x"]), ("x", None), ("ab", []), ("äß", ["aß", "äß!"])], "a string, b array<string>")
    assert [r[0] for r in rows.select(M.anls(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 1.0, 0.0, 0.0, 0.0, 2 / 3])
    pairs = spark.createDataFrame([("äb", "ab"), ("", "abc"), (None, "a"), ("abc", "")], "a string, b string")
    assert [r[0] for r in pairs.select(M.character_error_rate(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, None, 3.0]
