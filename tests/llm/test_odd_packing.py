"""Packing of nulls, empty, repeated and very long texts, with values."""

from collections import Counter

import public_tokenizers
import tokenizers

from textloom.llm import packing

from .test_ops import ODD, docs

LIBRARY = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_odd_rows(spark):
    out = packing.pack(docs(spark, ODD)).collect()
    want = Counter()
    for d, t in ((r[0], r[1]) for r in ODD):
        want[d] += len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert got == want and got[3] == got[1] == 1  # a null and an empty text have their end alone
    assert sorted(r.piece for r in out if r.doc_id == 4) == [0, 0]  # rows that repeat are packed each
    assert len({r.ids_crc32 for r in out if r.doc_id in (1, 3)}) == 1
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 1024
    assert len(by) == max(-(-sum(want.values()) // 1024), sum(-(-n // 1024) for n in want.values() if n > 1024))
