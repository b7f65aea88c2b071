"""OCR items of a page as rows and columns; tables, forms and their checks.

items: page, text, score, left, top, right, bottom. A page's items are a bounded group and are clustered together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import bound, strip, text


def running_groups(values: list[float], limit: float) -> list[int]:
    """A number for each of the sorted values: that of the first group whose mean is within the limit, else a new one."""
    means: list[float] = []
    sizes: list[int] = []
    out = []
    for v in values:
        at = next((k for k, m in enumerate(means) if abs(v - m) <= limit), len(means))
        if at == len(means):
            means.append(v)
            sizes.append(1)
        else:
            means[at], sizes[at] = (means[at] * sizes[at] + v) / (sizes[at] + 1), sizes[at] + 1
        out.append(at)
    return out


def cluster_rows(items: DataFrame, least: float = 6.0, share: float = 0.7, alone: float = 10.0) -> DataFrame:
    """items with row: by centres, within `share` of the median gap between them (gaps of a pixel don't count; `alone` without
    any). A row of one or two items right above or below one of three or more joins it, as headings over several columns do."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cy=(pdf.top + pdf.bottom) / 2).sort_values(["cy", "left"], kind="stable")
        gaps = sorted(g for g in np.diff(pdf.cy.to_numpy()) if g > 1.0)
        limit = max(least, gaps[len(gaps) // 2] * share) if gaps else alone
        pdf["row"] = running_groups(pdf.cy.tolist(), limit)
        joined: dict[int, int] = {}
        before: tuple[int, float, int] | None = None  # row, centre and items of the row above
        for row, own in pdf.groupby("row", sort=True):
            centre, n = own.cy.mean(), len(own)
            if before and centre - before[1] <= 2.5 * limit and (before[2] <= 2) != (n <= 2) and max(before[2], n) >= 3:
                joined[row] = before[0]
                before = (before[0], (before[1] * before[2] + centre * n) / (before[2] + n), before[2] + n)
            else:
                joined[row] = before[0] + 1 if before else 0
                before = (joined[row], centre, n)
        return pdf.assign(row=pdf.row.map(joined)).drop(columns="cy")

    return items.groupBy("page").applyInPandas(run, StructType([*items.schema.fields, StructField("row", LongType())]))


def columns(rows: DataFrame, share: float = 0.45, least: float = 10.0) -> DataFrame:
    """rows with col: centres within `share` of the upper-quartile gap between them are one column, parted halfway between their means."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = ((pdf.left + pdf.right) / 2).to_numpy()
        found = np.unique(centre)
        gaps = np.sort(np.diff(found))
        limit = max(least, gaps[int(len(gaps) * 0.75)] * share) if len(gaps) else least
        group = np.array(running_groups(found.tolist(), limit))
        means = np.sort([found[group == k].mean() for k in np.unique(group)])
        return pdf.assign(col=np.searchsorted((means[1:] + means[:-1]) / 2, centre, side="right"))

    return rows.groupBy("page").applyInPandas(run, StructType([*rows.schema.fields, StructField("col", LongType())]))


def cells(placed: DataFrame) -> DataFrame:
    """page, row, col, text: items of a cell joined from left to right."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    return placed.groupBy("page", "row", "col").agg(joined.alias("text"))


def grid(placed: DataFrame) -> DataFrame:
    """page, rows: the cells as an array of rows, empty where there is none."""
    c = cells(placed)
    width = c.groupBy("page").agg((F.max("col") + 1).cast("int").alias("width"))
    row = c.groupBy("page", "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), "text"))).alias("m")).join(width, "page")
    full = row.select("page", "row", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))
    return full.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))


def dedup_items(items: DataFrame, near: float = 8.0) -> DataFrame:
    """Greedy by score: an item within `near` of a kept one whose text holds its own (or is held) goes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values(["score", "text"], ascending=[False, True], kind="stable"), []
        keep = []
        for r in pdf.itertuples():
            same = any(abs(r.left - k.left) <= near and abs(r.top - k.top) <= near and (r.text in k.text or k.text in r.text) for k in kept)
            keep.append(not same)
            if not same:
                kept.append(r)
        return pdf[keep]

    return items.groupBy("page").applyInPandas(run, items.schema)


def low_quality_lines(lines: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, pos, line: lines that are joined words, full of odd characters, of odd case or of low score; distinct but for case."""
    n = F.length("line")
    joined = (n >= 10) & ~F.col("line").rlike("[ :：]")
    odd = F.regexp_count("line", F.lit(r"[^\p{L}\p{N}\s.,:;%()/-]")) / n > 0.15
    case = F.col("line").rlike("[a-z][A-Z]{2,}[a-z]")
    rows = lines.withColumn("line", strip(text("line"))).where((F.col("line") != "") & (joined | odd | case | (F.coalesce("score", F.lit(1.0)) < 0.7)))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", F.lower("line")).orderBy("pos"))).where("k = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("k") <= most).select("doc_id", "pos", "line")


def table_flags(headers: Column, rows: Column) -> Column:
    """struct ragged, empty_header, truncated of a table."""
    ragged = F.exists(rows, lambda r: F.size(r) != F.size(headers))
    empty = (F.size(headers) == 0) | F.exists(headers, lambda h: F.trim(text(h)) == "")
    short = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda c: F.length(F.trim(c)) == 1)))
    return F.struct(ragged.alias("ragged"), empty.alias("empty_header"), (short >= F.greatest(F.lit(3), F.size(headers))).alias("truncated"))


def clean_table(rows: Column, most: int = 30) -> Column:
    """struct headers, rows, ragged, empty_header, truncated: of a raw table's first rows those with any content, blanks squeezed
    and padded to one width; the first is the header, unless it is empty."""
    cell = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    kept = F.filter(F.transform(F.slice(rows, 1, most), lambda r: F.transform(r, lambda x: cell(x))), lambda r: F.exists(r, lambda x: x != ""))

    def made(t: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(t, lambda r: F.size(r))), F.lit(0))
        full = F.transform(t, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        empty = (F.size(t) > 0) & ~F.exists(F.coalesce(F.try_element_at(t, F.lit(1)), F.array().cast("array<string>")), lambda x: x != "")
        short = F.aggregate(full, F.lit(0), lambda n, r: n + F.size(F.filter(r, lambda x: F.length(x) == 1)))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(empty | (F.size(t) == 0), none).otherwise(F.try_element_at(full, F.lit(1))).alias("headers"), F.when(empty, full).otherwise(F.slice(full, 2, 1 << 30)).alias("rows"),
            (F.size(F.array_distinct(F.transform(t, lambda r: F.size(r)))) > 1).alias("ragged"), empty.alias("empty_header"), ((F.size(t) > 0) & (short >= F.greatest(F.lit(3), width))).alias("truncated"),
        )

    return bound(kept, made)


def table_preview(c: Column, rows: int = 8, cols: int = 12) -> Column:
    """Rows of a text table (pipes, # or tabs) as maps from header to cell."""
    lines = F.filter(F.split(text(c), "\n"), lambda x: x.rlike("[|#\t]") & ~x.rlike(r"^[\s|:#-]+$"))
    cut = lambda x: F.slice(F.transform(F.split(F.regexp_replace(x, r"^\s*[|#]|[|#]\s*$", ""), "[|#\t]"), strip), 1, cols)
    table = F.transform(lines, cut)
    head = F.try_element_at(table, F.lit(1))
    names = F.transform(head, lambda x, i: F.when(x == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(x))
    names = F.transform(names, lambda x, i: F.when(F.array_position(names, x) < i + 1, F.concat(x, F.lit("_"), (i + 1).cast("string"))).otherwise(x))
    body = F.slice(table, 2, rows)
    out = F.transform(body, lambda r: F.map_from_arrays(names, F.transform(names, lambda n, i: F.coalesce(F.try_element_at(r, i + 1), F.lit("")))))
    return F.when(F.size(lines) >= 2, out)


def form_pairs(lines: DataFrame) -> DataFrame:
    """doc_id, field, value: a label line without a value takes the next line that is no label."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.col("line").rlike(r"^[^:：]{1,30}[:：]\s*$")
    rows = lines.withColumn("label", label).withColumn("next", F.lead("line").over(w)).withColumn("next_label", F.lead("label").over(w))
    return rows.where("label AND next IS NOT NULL AND NOT next_label").select("doc_id", strip(F.regexp_replace("line", r"[:：]\s*$", "")).alias("field"), strip(F.col("next")).alias("value"))


# Labels of forms that stand without a colon.
LABELS = [
    "TO", "FROM", "DATE", r"FAX NO\.?", "FAX NUMBER", "PHONE NUMBER", "NUMBER OF PAGES INCLUDING COVER SHEET", "SENDER/?PHONE NUMBER", "SPECIAL INSTRUCTIONS", "NOTE", "MANUFACTURER", "BRAND",
    "TYPE OF PACKINGS", "REPORTING PERIODS", "TEST MARKET GEOGRAPHY", "PRICE POINT", "SALES FORCE INVOLVEMENT", "DISTRIBUTORS.*", "CHAINS.*", "INDEPENDENTS.*", "ADVERTISING.*",
]
COMPACT_LABELS = ["TO", "FROM", "DATE", "PHONE", "FAX", "PAGES", "REPORTINGPERIODS", "TESTMARKETGEOGRAPHY", "PRICEPOINT", "SALESFORCEINVOLVEMENT", "DISTRIBUTORS.*", "CHAINS.*", "INDEPENDENTS.*", "ADVERTISING.*", "TYPEOFPACKINGS", "MANUFACTURER", "BRAND"]
# End of the fixed values.


def _form_lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("doc_id", F.posexplode(F.transform(F.split(text("text"), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))).alias("pos", "line"))
    return rows.where("line <> ''")


def _first_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """doc_id, n, field, value: the first of pairs that differ by case only, `most` a document."""
    once = F.row_number().over(Window.partitionBy("doc_id", F.lower("field"), F.lower("value")).orderBy("pos"))
    kept = pairs.where("field <> '' AND value <> ''").withColumn("k", once).where("k = 1")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("n") <= most).select("doc_id", "n", "field", "value")


def section_pairs(texts: DataFrame, most: int = 10, chars: int = 260) -> DataFrame:
    """doc_id, n, field, value: a line that ends with a colon, or is a known label, takes the lines up to the next one, until they have `chars`."""
    rows = _form_lines(texts)
    label = F.col("line").rlike(r"(?i)^[A-Z][A-Z0-9 .&()/\-]{2,}[:：]$") | F.replace(F.col("line"), F.lit(" "), F.lit("")).rlike(f"(?i)^(?:{'|'.join(COMPACT_LABELS)})[:：]?$")
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("label", label).withColumn("part", F.sum(F.col("label").cast("int")).over(order)).where("part > 0")
    used = F.sum(F.when(~F.col("label"), F.length("line") + 1).otherwise(0)).over(Window.partitionBy("doc_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("used", F.coalesce(used, F.lit(0)) - 1).where((F.col("used") < chars) | F.col("label"))
    field = F.max(F.when(F.col("label"), F.trim(F.regexp_replace("line", "[:：]+$", ""))))
    value = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("label"), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    return _first_pairs(rows.groupBy("doc_id", "part").agg(F.min("pos").alias("pos"), field.alias("field"), value.alias("value")), most)


def reading_order_pairs(texts: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, n, field, value: what stands behind a line's first colon, or on the next line if nothing does or the line is a known label."""
    rows = _form_lines(texts).withColumn("next", F.lead("line").over(Window.partitionBy("doc_id").orderBy("pos")))
    colon = F.contains("line", F.lit(":"))
    behind = F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    known = F.col("line").rlike(f"(?i)^(?:{'|'.join(LABELS)})[:：]?$")
    field = F.when(colon, F.concat(F.trim(F.regexp_extract("line", "^([^:]*):", 1)), F.lit(":"))).when(known, F.col("line"))
    value = F.when(colon & (behind != ""), behind).otherwise(F.coalesce("next", F.lit("")))
    return _first_pairs(rows.select("doc_id", "pos", field.alias("field"), value.alias("value")).where(F.length("field") >= 2), most)


def merge_pairs(sources: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Pairs (doc_id, kind, pos, field, value) of several kinds in the order of `caps`: the first of equal fields and values, each kind capped."""
    order = F.create_map(*[x for k, name in enumerate(caps) for x in (F.lit(name), F.lit(k))])
    cap = F.create_map(*[x for name, n in caps.items() for x in (F.lit(name), F.lit(n))])
    rows = sources.withColumn("o", order[F.col("kind")]).where("o IS NOT NULL")
    first = Window.partitionBy("doc_id", F.lower("field"), F.lower("value")).orderBy("o", "pos")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos"))).where(F.col("k") <= cap[F.col("kind")])
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "pos"))).select("doc_id", "n", "kind", "field", "value")


def fuse_pairs(sources: DataFrame, most: int = 16, least: int = 3) -> DataFrame:
    """doc_id, n, field, value, type of a form's pairs (doc_id, kind, pos, field, value): slots, layout, reading order, sections and
    plain lines in this order, names and values without separators, each pair once. Layouts of other variants (kind layout2) count
    where the first layout has fewer than `least` pairs."""
    from ..functions.query import field_type
    from ..functions.text import form_text

    kinds = ["slots", "layout", "layout2", "reading", "sections", "lines"]
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    laid = F.sum((F.col("kind") == "layout").cast("int")).over(Window.partitionBy("doc_id"))
    rows = sources.withColumn("laid", laid).where((F.col("kind") != "layout2") | (F.col("laid") < least))
    rows = rows.withColumns({"o": order, "field": form_text(F.col("field"), True), "value": form_text(F.col("value"))}).where("o > 0 AND field <> '' AND value <> ''")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", F.lower("field"), F.lower("value")).orderBy("o", "pos"))).where("k = 1")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "pos"))).where(F.col("n") <= most)
    return rows.select("doc_id", "n", "field", "value", field_type(F.col("field"), F.col("value")).alias("type"))


def paired_answers(items: DataFrame) -> DataFrame:
    """doc_id, question, answer: an answer takes the last question that none has taken."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = items.withColumn("q", F.sum((F.col("kind") == "question").cast("int")).over(w))
    first = F.row_number().over(Window.partitionBy("doc_id", "q", "kind").orderBy("pos"))
    rows = rows.withColumn("first", first)
    q = rows.where("kind = 'question'").select("doc_id", "q", F.col("text").alias("question"))
    a = rows.where("kind = 'answer' AND first = 1 AND q > 0").select("doc_id", "q", F.col("text").alias("answer"))
    return q.join(a, ["doc_id", "q"]).select("doc_id", "question", "answer")
