"""Texts that hold the added token, against the library at its default."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import packing, token_counts

from .test_ops import docs

library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
counter = token_counts.Counter(open(public_tokenizers.path(packing.RANKS), "rb").read())
pieces = st.lists(st.sampled_from(["<|endoftext|>", "<|", "endoftext", "|>", "<", ">", "a", " ", "  ", "\n", "'s", "1", "é"]), max_size=40).map("".join)


def test_packed_ids(spark):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>", 3: "x  <|endoftext|", 4: "<<|endoftext|>>"}
    found = packing.pack(docs(spark, list(texts.items())), with_ids=True).collect()
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    assert want[1] == [64, 220, 50256, 275, 2] and {r.doc_id: list(r.ids) for r in found} == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)


@settings(max_examples=300, deadline=None)
@given(pieces, st.lists(st.tuples(st.integers(0, 150), st.integers(0, 150), pieces), max_size=5))
def test_counts_and_edits(text, edits):
    parts = token_counts.split(text)
    tree = token_counts.TokenTree(parts, [counter(p) for p in parts], counter)
    assert tree.count == len(library.encode(text, add_special_tokens=False).ids)
    for start, stop, new in edits:
        a = min(start, len(text))
        text = text[:a] + new + text[min(max(stop, a), len(text)) :]
        tree.edit(start, stop, new)
        assert tree.parts() == token_counts.split(text) and tree.count == len(library.encode(text, add_special_tokens=False).ids)
