"""Edit distances over code points, bit-parallel, in Arrow batches.

A column of the distance matrix is two integers of as many bits as the longer text has characters: where the next row is one
more, and where one less. A character of the shorter text turns one column into the next by a dozen operations on these,
so whole turns and pages cost their product over the word size. Common ends are cut off first. Where only distances up to a
cut matter, texts of too different lengths cost nothing, and a run ends as soon as what is left can't bring it back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType


def distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions and replacements from a to b; with a cut, any number above it for distances above it."""
    if len(a) < len(b):
        a, b = b, a
    if most is not None and len(a) - len(b) > most:
        return most + 1
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    shift = len(a) - end
    while end > start and a[end - 1 + shift] == b[end - 1]:
        end -= 1
    a, b = a[start : end + shift], b[start:end]
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, now, left = every, 0, len(a), len(b)
    for c in b:
        same = places.get(c, 0)
        diagonal = same | down | ((same & up) + up ^ up)
        right, back = down | every & ~(diagonal | up), up & diagonal
        now += bool(right & last) - bool(back & last)
        right, back = right << 1 | 1, back << 1
        up, down = every & (back | ~(diagonal | right)), every & right & diagonal
        left -= 1
        if most is not None and now - left > most:
            return most + 1
    return now


@F.pandas_udf(LongType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where a text is null."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(DoubleType())
def best_similarity(a: pd.Series, answers: pd.Series) -> pd.Series:
    """The largest 1 - distance / longer length to any answer that isn't null (1 for two empty texts); null without one."""

    def best(x, found) -> float | None:
        top = None
        for y in () if x is None or found is None else (y for y in found if y is not None):
            longest = max(len(x), len(y))
            cut = None if top is None else int((1 - top) * longest + 1e-9)
            own = 1.0 if not longest else 1 - distance(x, y, cut) / longest
            top = own if top is None or own > top else top
        return top

    return pd.Series([best(x, found) for x, found in zip(a, answers, strict=True)], dtype="float64")
