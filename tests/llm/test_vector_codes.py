"""Product codes against a computation by definition, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from textloom.llm import vector_codes as vc

from ..compare import same
from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code int"


def brute(rows):
    size = len(rows[0][1]) // 8
    whole = [(i, [math.floor(4096 * x) if abs(x) < 1e30 else int(x) * 4096 for x in v], label) for i, v, label in rows]
    part = lambda v, p: v[p * size : (p + 1) * size]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    first = sorted((i, v) for i, v, _ in whole if i is not None)[:16]
    books = [[part(v, p) for _, v in first] for p in range(8)]
    code = lambda v: [min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e)) for p in range(8)]
    for _ in range(6):
        codes = [code(v) for _, v, _ in whole]
        for p in range(8):
            for e in range(len(first)):
                own = [part(v, p) for (_, v, _), c in zip(whole, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v, label in whole:
        c = code(v)
        out.append((i, "".join(f"{x:02x}" for x in c), sum(far(part(v, p), books[p][c[p]]) for p in range(8)), label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted([(i, c, min(e, most), min(sum(min(x[2], most) for x in out if x[3] == label), most), sha) for i, c, e, label in out], key=repr)


def found(spark, rows):
    df = vc.vector_codes(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_sql(spark, duck):
    same(vc.query(spark, SF), duck, vc.ORACLE)


def test_definition(spark):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.choice([-1, -0.3, 0, 0.11, 2]) + r.choice([0, 0, 1e-5]))) for _ in range(32)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(5, rows[5][1], 7), (5, rows[5][1], 7), (None, [0.5] * 32, None), (None, [-9.5] * 32, 2)]  # repeated rows, no id
    bad = [(-1, None, 1), (-2, [None] * 32, 1), (-3, [float("nan")] * 32, 1), (-4, [float("-inf")] + [0.0] * 31, 1), (999, [1.0] * 40, 1), (-6, [], 1), (-7, [1.0] * 9, 1)]
    assert found(spark, rows + bad) == brute(rows)


def test_few_rows_huge_values_and_no_rows(spark):
    rows = [(3, [1e38] * 8 + [-1e38] * 8, 1), (1, [float(np.float32(-3e38))] * 16, None), (2, [0.25] * 16, None), (9, [0.25] * 16, 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, None, 2)]) == []


@pytest.mark.parametrize("size", [1, 2, 6, 8, 64])
def test_bounds_lose_nothing_and_spare_work(size):
    r = np.random.default_rng(size)
    book = r.integers(-9000, 9000, (16, size))
    x = np.concatenate([book[r.integers(0, 16, 900)] + r.integers(-40, 40, (900, size)), r.integers(-9000, 9000, (100, size)), (book[:8] + book[8:]) // 2])
    code, far, taken = vc.nearest(x, book)
    all_far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (code == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    assert taken < 0.6 * all_far.size  # exact distances
