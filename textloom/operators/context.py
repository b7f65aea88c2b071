"""What is put around hits: neighbours, parents, islands of adjacent chunks, and budgets that stop at the first overflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, sentences, strip, text


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """query_id, center_id and the chunks of the same document up to `window` places away. Equi-join on each place."""
    away = [d for d in range(-window, window + 1) if d]
    places = hits.select("query_id", F.col("chunk_id").alias("center_id"), "doc_id", F.explode(F.array(*[(F.col("chunk_index") + d).cast("int") for d in away])).alias("chunk_index"))
    return places.join(chunks.select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select("query_id", "center_id", "doc_id", "chunk_index", "chunk_id")


def siblings(hits: DataFrame, chunks: DataFrame, group: int = 4) -> DataFrame:
    """query_id, center_id and the other chunks of the hit's group of `group`."""
    g = F.floor(F.col("chunk_index") / group).alias("grp")
    own = hits.select("query_id", F.col("chunk_id").alias("center_id"), "doc_id", g)
    return own.join(chunks.select("doc_id", "chunk_index", "chunk_id", g), ["doc_id", "grp"]).where("chunk_id <> center_id").select("query_id", "center_id", "doc_id", "chunk_index", "chunk_id")


def joined_content(chunks: DataFrame, by: list[str], gap: str = "\n\n") -> DataFrame:
    """Contents of each group in chunk order."""
    return chunks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), gap).alias("content"))


def with_context(hits: DataFrame, chunks: DataFrame, window: int = 1, group: int = 4) -> DataFrame:
    """Hits and what surrounds them, in document order; is_primary marks the hits."""
    own = hits.select("query_id", "doc_id", "chunk_index", "chunk_id", F.lit(True).alias("is_primary"))
    more = neighbours(hits, chunks, window).union(siblings(hits, chunks, group)).select("query_id", "doc_id", "chunk_index", "chunk_id", F.lit(False).alias("is_primary"))
    return own.union(more).groupBy("query_id", "doc_id", "chunk_index", "chunk_id").agg(F.max("is_primary").alias("is_primary"))


def backfill(hits: DataFrame, base_k: int, k: int, per_doc: int = 2) -> DataFrame:
    """`per_doc` hits of a document until base_k are chosen, then the ones passed over while scanning, up to k."""
    w = Window.partitionBy("query_id").orderBy("rank")
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    rows = hits.withColumn("first", own <= per_doc)
    taken = F.sum(F.col("first").cast("int")).over(w)
    rows = rows.withColumn("taken", taken).where((F.col("first") & (F.col("taken") <= base_k)) | (~F.col("first") & (F.col("taken") < base_k)))
    order = Window.partitionBy("query_id").orderBy(F.desc("first"), "rank")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("first", "taken")


def islands(hits: DataFrame, gap: str = "\n", chars: int | None = None) -> DataFrame:
    """Adjacent chunks of a document become one segment with the best score and the first one's section; contents are joined, clipped before if `chars` says so."""
    w = Window.partitionBy("query_id", "doc_id").orderBy("chunk_index")
    start = F.coalesce((F.col("chunk_index") - F.lag("chunk_index").over(w) > 1).cast("int"), F.lit(1))
    content = F.col("content") if chars is None else clip(strip(text("content")), chars)
    rows = hits.withColumn("content", content).withColumn("start", start).withColumn("island", F.sum("start").over(w))
    return rows.groupBy("query_id", "doc_id", "island").agg(
        F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.max("score").alias("score"), F.min_by("section_path", "chunk_index").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), gap).alias("content"),
    )


def prefix_budget(rows: DataFrame, by: list[str], order: list, size: Column, most: int) -> DataFrame:
    """Rows in order until one would pass the budget; later ones don't sneak in, however small."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= most)


def assemble(hits: DataFrame, most: int = 5200, chars: int = 900) -> DataFrame:
    """query_id, segment, block: segments under a header line, best first, within the character budget; chunks are clipped to `chars`."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "first_index")
    rows = islands(hits, "\n\n", chars).withColumn("segment", F.row_number().over(w))
    section = F.coalesce(F.nullif(strip(text("section_path")), F.lit("")), F.lit("-"))
    head = F.format_string("[%d] doc=%s section=%s score=%.3f\n", F.col("segment"), F.col("doc_id").cast("string"), section, F.col("score"))
    rows = rows.select("query_id", "segment", strip(F.concat(head, text("content"))).alias("block"))
    return prefix_budget(rows, ["query_id"], ["segment"], F.length("block") + 2, most).select("query_id", "segment", "block")


def best_sentences(hits: DataFrame, score: Column, around: int = 1) -> DataFrame:
    """query_id, chunk_id, snippet: the sentence that scores best (the first of equals) with `around` on either side.

    `score` is an expression over the column s, a sentence.
    """
    rows = hits.withColumn("sents", sentences(text("content"))).select("query_id", "chunk_id", "sents", F.posexplode("sents").alias("pos", "s"))
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("sc"), "pos")
    rows = rows.withColumn("sc", score).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    start = F.greatest(F.col("pos") - around, F.lit(0))
    return rows.select("query_id", "chunk_id", F.array_join(F.slice("sents", start + 1, F.col("pos") + around - start + 1), " ").alias("snippet"), F.col("sc").alias("sentence_score"))


def annotate(hits: DataFrame, most_hits: int = 8, chars: int = 300, budget: int = 5200) -> DataFrame:
    """query_id, n, line: 【n】 snippet (来源: year, file > section), until the budget is full."""
    source = F.concat_ws(", ", F.nullif(text("year"), F.lit("")), F.concat_ws(" > ", text("file"), F.nullif(text("section_path"), F.lit(""))))
    line = F.format_string("【%d】%s (来源: %s)", F.col("rank"), F.substring(text("content"), 1, chars), source)
    rows = hits.where(F.col("rank") <= most_hits).select("query_id", F.col("rank").alias("n"), line.alias("line"))
    return prefix_budget(rows, ["query_id"], ["n"], F.length("line"), budget).select("query_id", "n", "line")


def diverse_first(hits: DataFrame, most: int = 15, least_hits: int = 6, least_docs: int = 3) -> DataFrame:
    """The first hit of each document in front, if there are enough hits and documents."""
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    rows = hits.withColumn("own", own)
    lead = (F.col("own") == 1) & (F.sum((F.col("own") == 1).cast("int")).over(Window.partitionBy("query_id").orderBy("rank")) <= most)
    q = Window.partitionBy("query_id")
    rows = rows.withColumn("lead", lead)
    use = (F.count("*").over(q) >= least_hits) & (F.sum(F.col("lead").cast("int")).over(q) >= least_docs)
    rows = rows.withColumn("use", use)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("use") & F.col("lead")), "rank")
    return rows.withColumn("place", F.row_number().over(order)).drop("own", "lead", "use")
