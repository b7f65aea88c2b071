"""Pairs of characters in texts, counted in one pass, and pieces put together with one exchange."""

import pandas as pd

from textloom.operators import relevance
from textloom.streaming import events


def test_found_pairs_like_looking_for_each():
    texts = ["", None, "a", "ab", "abcabd" * 60 + "xyz漢字😀é", "x" * 1200 + "ab", "aaa", "\x00a\x00"]
    prompts = ["", None, "a", "abd zé字😀", "漢字😀é", "aaaa", "xyab", "\x00a"]
    cases = [(t, p) for t in texts for p in prompts]
    want = []
    for t, p in cases:
        pairs, t = {(p or "")[k : k + 2] for k in range(len(p or "") - 1)}, t or ""
        want.append([len(pairs), sum(x in t for x in pairs), sum(x in t[: max(200, len(t) // 5)] for x in pairs)])
    assert relevance.found_pairs(pd.Series([t for t, _ in cases], dtype=object), pd.Series([p for _, p in cases], dtype=object)).tolist() == want


def test_pieces_move_once(spark):
    rows = [("t", 0, 1, "b"), ("t", 0, 0, "a"), ("t", 0, 1, "b"), ("t", 0, 2, None), ("t", 1, 0, None), (None, 0, 0, "x"), ("u", None, 3, "z"), ("u", None, None, "y"), ("t", 0, 1, "c"), ("t", 0, 1, None)]
    made = events.assembled(spark.createDataFrame(rows, "task_id string, section int, seq long, piece string").repartition(3))
    assert sorted(map(tuple, made.collect()), key=repr) == sorted([("t", 0, "ab"), ("t", 1, ""), (None, 0, "x"), ("u", None, "yz")], key=repr)
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(task_id") == 1
