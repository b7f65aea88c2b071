"""Table functions: one text becomes rows. They run in Arrow batches and serve DataFrames (lateral joins) and SQL alike."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class ChunkText:
    """chunk_text(body, markdown, target, overlap): part, content. A section's blocks (paragraphs, if it isn't Markdown) packed up to the target."""

    def eval(self, body: str, markdown: bool, target: int, overlap: int) -> Iterator[tuple[int, str]]:
        from ..operators.chunking import blocks, pack_blocks, plain_paragraphs

        if body:
            yield from enumerate(pack_blocks(blocks(body) if markdown else plain_paragraphs(body), target, overlap))


class SplitText:
    """split_text(body, size, overlap): part, content. Pieces of the plain recursive splitter with blanks squeezed, each behind the end of the one before."""

    def eval(self, body: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        from ..operators.chunking import plain_recursive

        tail = ""
        for part, piece in enumerate(plain_recursive(body or "", size)):
            yield part, re.sub(r"\s+", " ", tail + piece).strip()
            tail = piece[-overlap:] if overlap else ""


RETURNS = "part int, content string"
FUNCTIONS = {"chunk_text": ChunkText, "split_text": SplitText}


def function(name: str):
    """The table function for DataFrames."""
    return F.udtf(FUNCTIONS[name], returnType=RETURNS, useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: SELECT doc_id, c.* FROM docs, LATERAL chunk_text(text, true, 700, 100) AS c."""
    for name in FUNCTIONS:
        spark.udtf.register(name, function(name))
