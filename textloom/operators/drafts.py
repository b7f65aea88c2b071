"""What goes into a draft and how a draft is judged: digests of sources, fall-back texts, headings, critics, tables, OCR variants.

Groups are the records, headings or lines of one document or task, a bounded group. What a model writes comes in as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import edit_similarity
from ..functions.query import any_of
from ..functions.text import CJK, best_text, first_of_each, merge_lines, ocr_quality, strip, text

# Words that the rules for headings, citations and forms are made of.
TEMPLATES = ["背景", "概述", "分析", "建议", "总结", "引言", "展望", "介绍", "现状", "意义", "讨论", "结论", "对策", "方案", "趋势"]
CRITICAL = ["局限", "不足", "限制", "缺口", "改进", "风险", "挑战", "不确定性", "失败", "对比", "争议", "缺陷"]
DETAIL = r"\d+[%％]|\d+[个项种类条]|[0-9]+(?:\.\d+)?"
VAGUE = {
    "据[^，。；]{0,20}(?:报告|统计|数据|调查|预测|分析)": "未指明具体报告名称",
    "(?:有研究|有学者|有报告|有文章)[^，。；]{0,10}(?:表明|显示|指出|发现|认为)": "未指明研究/学者名称",
    "据[报悉了][^，。；]{0,8}[道称]": "未指明信息来源",
    "(?:据了解|据悉|据闻|据报道|据透露)": "使用了不确定来源的引述",
    "(?:相关研究|相关报告|相关数据|相关调查)[^，。；]{0,10}(?:表明|显示|指出)": "未指明具体出处",
}
FORM_MARKS = r"(?i)\b(to|from|date|fax|phone|number|address|note|sender|recipient|policy|claim|account|market|brand|manufacturer)\b|[:：]"
NO_SOURCES = "（无源材料）"
FALLBACK = "本节围绕相关材料进行归纳整理，并给出可执行的观点与结论。"
INJECTED = " It was officially revised in 2019 according to later reports."
# End of the fixed values.


def _in_order(by: str, order: str):
    return Window.partitionBy(by).orderBy(order)


def _joined(rows: DataFrame, by: str, order: str, line: str, gap: str = "\n") -> DataFrame:
    """by, text: lines of each group in order."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), gap).alias("text"))


def _filled(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x != "")


def short_digest(records: DataFrame, by: str = "task_id", most: int = 1600, points: int = 3) -> DataFrame:
    """by, text: a line of title, summary, key points and conclusion for each record, until the lines reach `most`; the whole is clipped there.

    records: by, order_index, title, summary, key_points, conclusion.
    """
    own = F.array_join(F.filter(F.transform(F.slice(F.coalesce("key_points", F.array().cast("array<string>")), 1, points), strip), lambda x: x != ""), "；")
    line = F.array_join(_filled(strip(text("title")), strip(text("summary")), own, strip(text("conclusion"))), " | ")
    rows = records.select(by, "order_index", line.alias("line")).where("line <> ''").withColumn("line", F.concat(F.lit("- "), "line"))
    before = F.coalesce(F.sum(F.length("line")).over(_in_order(by, "order_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _joined(rows.withColumn("before", before).where(F.col("before") < most), by, "order_index", "line")
    return out.withColumn("text", F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("…"))).otherwise(F.col("text")))


def judge_summary(records: DataFrame, by: str = "task_id", most: int = 2000, points: int = 5) -> DataFrame:
    """by, text: title, 200 characters of the summary and five key points of each record; the one that would pass `most` is clipped and ends it."""
    own = F.array_join(F.slice(F.coalesce("key_points", F.array().cast("array<string>")), 1, points), "; ")
    title = F.when(strip(text("title")) != "", F.concat(F.lit("["), strip(text("title")), F.lit("] "))).otherwise("")
    line = F.concat(title, F.substring(strip(text("summary")), 1, 200), F.when(own != "", F.concat(F.lit(" 要点: "), own)).otherwise(""))
    rows = records.select(by, "order_index", line.alias("line")).where(F.trim("line") != "")
    before = F.coalesce(F.sum(F.length("line")).over(_in_order(by, "order_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("before", before).where(F.col("before") <= most).withColumn("line", F.substring(F.col("line"), F.lit(1), F.greatest(F.lit(0), most - F.col("before"))))
    return records.select(by).distinct().join(_joined(kept, by, "order_index", "line"), by, "left").withColumn("text", F.coalesce("text", F.lit(NO_SOURCES)))


def web_citations(articles: DataFrame, by: str = "task_id", most: int = 8) -> DataFrame:
    """by, text: 【Wn】 title, snippet and link of the first articles (by, pos, title, url, snippet) that have a title."""
    rows = articles.withColumn("k", F.row_number().over(_in_order(by, "pos"))).where((F.col("k") <= most) & (strip(text("title")) != ""))
    rows = rows.withColumn("n", F.row_number().over(_in_order(by, "pos")))
    line = F.format_string("【W%d】 %s\n   摘要: %s\n   链接: %s", F.col("n"), strip(text("title")), F.substring(strip(text("snippet")), 1, 200), strip(text("url")))
    return _joined(rows.select(by, "n", line.alias("line")), by, "n", "line")


def fallback_section(previous: Column, digest: Column) -> Column:
    """A section without a model: the summary before it and the first three lines of the digest as sentences."""
    lines = F.filter(F.transform(F.split(text(digest), "\r?\n"), lambda x: F.regexp_replace(strip(x), "^[- ]+|[- ]+$", "")), lambda x: x != "")
    parts = F.filter(F.array(strip(text(previous)), F.array_join(F.slice(lines, 1, 3), "；")), lambda x: x != "")
    out = F.concat(F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, "^。+|。+$", "")), "。"), F.lit("。"))
    return F.when(F.size(parts) == 0, FALLBACK).otherwise(F.replace(out, F.lit("。。"), F.lit("。")))


def knowledge_points(context: Column, title: Column) -> Column:
    """Points of the block [章节素材: title], or of one whose name begins with the title's first four characters; of three characters or more."""
    quoted = lambda t: F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    block = lambda name: F.concat(F.lit(r"(?s)\[章节素材:\s*"), name, F.lit(r"\][^\[]*?知识点:\s*(.+?)(?:\n|$)"))
    found = lambda name: F.regexp_extract_all(text(context), block(name), F.lit(1))
    exact, near = found(quoted(title)), found(F.concat(quoted(F.substring(title, 1, 4)), F.lit(r"[^\]]*")))
    raw = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(near, F.lit(1)), F.lit(""))
    points = F.filter(F.transform(F.split(raw, "[；;]"), strip), lambda x: F.length(x) >= 3)
    return F.when(text(title) == "", F.array().cast("array<string>")).otherwise(points)


def checklists(answers: DataFrame, titles: DataFrame, most: int = 5) -> DataFrame:
    """id, title, points: of a model's list (id, answer: `## name` and `- point` lines) what belongs to each wanted title (id, pos, title).

    A name belongs to a title if one's first four characters occur in the other; the first such name counts, and points of
    more than five characters.
    """
    lines = answers.select("id", F.posexplode(F.transform(F.split(text("answer"), "\r?\n"), strip)).alias("at", "line"))
    head = F.when(F.col("line").startswith("## "), strip(F.substring("line", 4, 1 << 20)))
    lines = lines.withColumn("name", F.last(head, ignorenulls=True).over(_in_order("id", "at"))).where("name IS NOT NULL")
    point = F.when(F.col("line").startswith("- ") & (F.length(strip(F.substring("line", 3, 1 << 20))) > 5), F.struct("at", strip(F.substring("line", 3, 1 << 20)).alias("x")))
    lists = lines.groupBy("id", "name").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(point)).alias("points"))
    near = F.contains("name", F.substring("title", 1, 4)) | F.contains("title", F.substring("name", 1, 4))
    best = Window.partitionBy("id", "title").orderBy("first")
    rows = titles.join(lists, "id").where(near).withColumn("k", F.row_number().over(best)).where("k = 1")
    return rows.select("id", "title", F.slice(F.transform("points", lambda p: p["x"]), 1, most).alias("points"))


def bare_title(c: Column) -> Column:
    """A heading without its number."""
    return strip(F.regexp_replace(c, r"^[\d.]+\s*", ""))


def is_template(c: Column) -> Column:
    """A heading of eight characters or fewer with a word that says nothing of its content."""
    return any_of(bare_title(c), TEMPLATES) & (F.length(bare_title(c)) <= 8)


def _numbered_levels(headings: DataFrame) -> DataFrame:
    return headings.where(F.col("level").between(2, 3)).withColumn("bare", bare_title(F.col("title")))


def naming_issues(headings: DataFrame, alike: float = 0.7) -> DataFrame:
    """doc_id, order_index, issue: headings of levels 2 and 3 that are short (under four characters), a template, or alike the one behind them."""
    rows = _numbered_levels(headings)
    rows = rows.withColumn("next", F.lead("bare").over(_in_order("doc_id", "order_index")))
    issue = F.array_compact(F.array(
        F.when(F.length("bare") < 4, F.lit("short")), F.when(is_template(F.col("title")), F.lit("template")),
        F.when(F.col("next").isNotNull() & (edit_similarity(F.col("bare"), F.col("next")) > alike), F.lit("alike")),
    ))
    return rows.select("doc_id", "order_index", F.explode(issue).alias("issue"))


def critical_issue(headings: DataFrame) -> DataFrame:
    """doc_id, issue of outlines of three sections or more: missing if neither of the last two names limits, vague if one does without
    a figure in its subsections and with one of these at most; null if all is well."""
    order = _in_order("doc_id", "order_index")
    rows = headings.where(F.col("level").between(2, 3)).withColumn("h2", F.sum((F.col("level") == 2).cast("int")).over(order))
    rows = rows.withColumn("n", F.max("h2").over(Window.partitionBy("doc_id"))).withColumn("critical", (F.col("level") == 2) & any_of(F.col("title"), CRITICAL))
    rows = rows.withColumn("within", F.max("critical").over(Window.partitionBy("doc_id", "h2")))
    sub = (F.col("level") == 3) & F.col("within")
    per = rows.groupBy("doc_id").agg(
        F.max("n").alias("n"), F.max(F.col("critical") & (F.col("h2") > F.col("n") - 2)).alias("named"),
        F.sum(sub.cast("int")).alias("subs"), F.max(sub & F.col("title").rlike(DETAIL)).alias("detail"),
    )
    issue = F.when(F.col("n") < 3, None).when(~F.col("named"), "missing").when(~F.col("detail") & (F.col("subs") <= 1), "vague")
    return per.select("doc_id", issue.alias("issue"))


def outline_metrics(headings: DataFrame) -> DataFrame:
    """doc_id, h2, h3, headings, templates, emptiness: the share of headings of levels 2 and 3 that are templates."""
    rows = _numbered_levels(headings).withColumn("t", is_template(F.col("title")).cast("int"))
    per = rows.groupBy("doc_id").agg(F.sum((F.col("level") == 2).cast("int")).alias("h2"), F.sum((F.col("level") == 3).cast("int")).alias("h3"), F.count("*").alias("headings"), F.sum("t").alias("templates"))
    return per.withColumn("emptiness", F.round(F.col("templates") / F.col("headings"), 4))


def outline_verdict(structure: Column, missing: Column, coverage: Column, soft: Column) -> Column:
    """accept, accept_with_warnings, retry_coverage or retry_structure of an attempt, by its numbers of structural issues and
    missing sections, its topic coverage, and its number of soft warnings."""
    return F.when(structure > 0, "retry_structure").when((missing > 0) | (coverage < 0.5), "retry_coverage").when(soft > 0, "accept_with_warnings").otherwise("accept")


def accepted_outline(attempts: DataFrame) -> DataFrame:
    """doc_id, attempt, outline, verdict: the first attempt that is accepted, else the last one."""
    rows = attempts.withColumn("ok", F.col("verdict").startswith("accept"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id", "attempt", "outline", "verdict")


def missing_topics(answer: Column, most: int = 8) -> Column:
    """Topics that a model lists as missing; none if it answers that all are there."""
    a = strip(text(answer))
    lines = F.transform(F.split(a, "\r?\n"), lambda x: F.regexp_replace(strip(x), "^[-•·0-9. ]+", ""))
    return F.when(F.upper(a).isin("OK", "OK。", "无", "无缺失", "NONE", "N/A"), F.array().cast("array<string>")).otherwise(F.slice(F.filter(lines, lambda x: F.length(x) > 1), 1, most))


def fix_needed(fixable: Column, low: Column) -> Column:
    """Whether issues below 高 are worth a model's correction: not for three or fewer that are all 低."""
    return (fixable > 0) & ~((fixable <= 3) & (low == fixable))


def accept_fix(content: Column, fixed: Column) -> Column:
    """A correction, unless it has lost half of the text."""
    return F.when((text(fixed) != "") & (F.length(strip(text(fixed))) > F.length(content) * 0.5), strip(text(fixed))).otherwise(content)


def critic_answer(content: Column, first: Column, retry: Column, heuristic: Column) -> Column:
    """Which critic counts for a text: none under 100 characters, else the model's first answer, its second one, the heuristic."""
    full = lambda c: strip(text(c)) != ""
    return F.when(F.length(text(content)) < 100, "").when(full(first), strip(text(first))).when(full(retry), strip(text(retry))).otherwise(text(heuristic))


def review_layers(content: Column) -> Column:
    """Layers of a coherence review by length: 2 under 3000 characters, 3 (a model) under 8000, 4 (facts too) beyond."""
    return F.when(F.length(text(content)) < 3000, 2).when(F.length(text(content)) < 8000, 3).otherwise(4)


def vague_citations(c: Column, most: int = 10) -> Column:
    """Structs text and reason of citations that name no source, outside of brackets that do; equal ones once."""
    c = text(c)
    near = "(?<![（(]据[\\s\\S]{0,28})"
    def cites(p: str, why: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(near + p), 0), lambda x: F.struct(F.substring(x, 1, 80).alias("text"), F.lit(why).alias("reason")))

    found = F.concat(*[cites(p, why) for p, why in VAGUE.items()])
    return F.slice(first_of_each(found, lambda x: x["text"]), 1, most)


def table_summary(page: Column, rows: Column, headers: Column, caption: Column) -> Column:
    """One line on a table: its page, size, first six headers and caption."""
    names = F.filter(F.transform(headers, lambda h: F.trim(F.coalesce(h, F.lit("")))), lambda h: h != "")
    bits = F.array_compact(F.array(
        F.format_string("第 %d 页表格", page), F.format_string("%d 行 %d 列", F.size(rows), F.size(headers)),
        F.when(F.size(names) > 0, F.concat(F.lit("表头："), F.array_join(F.slice(names, 1, 6), "/"))),
        F.when(strip(text(caption)) != "", F.concat(F.lit("标题："), strip(text(caption)))),
    ))
    return F.concat(F.lit("（"), F.array_join(bits, "，"), F.lit("）"))


def captions(tables: DataFrame, lines: DataFrame, above: float = 90, below: float = 70) -> DataFrame:
    """tables (page, table_id, top, bottom) with caption: the nearest line (page, y, line) of 3 to 80 characters above, else below; '' without any."""
    rows = lines.withColumn("line", strip(text("line"))).where(F.length("line").between(3, 80))
    near = tables.select("page", "table_id", "top", "bottom").join(rows, "page").where(F.col("y").between(F.col("top") - above, F.col("top")) | F.col("y").between(F.col("bottom"), F.col("bottom") + below))
    over = F.col("y") <= F.col("top")
    w = Window.partitionBy("page", "table_id").orderBy(F.desc(over), F.when(over, -F.col("y")).otherwise(F.col("y")))
    best = near.withColumn("k", F.row_number().over(w)).where("k = 1").select("page", "table_id", F.col("line").alias("caption"))
    return tables.join(best, ["page", "table_id"], "left").withColumn("caption", text("caption"))


def compact_tables(tables: DataFrame, by: str = "doc_id", most: int = 8000) -> DataFrame:
    """by, text: summary lines (by, order_index, line) until they reach `most`."""
    before = F.coalesce(F.sum(F.length("line")).over(_in_order(by, "order_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _joined(tables.withColumn("before", before).where(F.col("before") < most), by, "order_index", "line")


def ocr_variants(raw: Column, light: Column, strong: Column, marks: int = 5, score: float = 78, most: int = 80) -> Column:
    """struct best, text, wants_aux: the variant of the best quality, all variants merged from the best on, and whether a second
    engine should look: if the best one has `marks` signs of a form or is under `score`."""
    best = best_text(raw, light, strong)
    ranked = F.transform(F.reverse(F.array_sort(F.transform(F.array(raw, light, strong), lambda x, i: F.struct(ocr_quality(strip(F.coalesce(x, F.lit("")))).alias("q"), (-i).alias("i"), strip(F.coalesce(x, F.lit(""))).alias("x"))))), lambda y: y["x"])
    whole = merge_lines(merge_lines(ranked[0], ranked[1], most), ranked[2], most)
    return F.struct(best.alias("best"), whole.alias("text"), ((F.regexp_count(best, F.lit(FORM_MARKS)) >= marks) | (ocr_quality(best) < score)).alias("wants_aux"))


def compose_record(body: Column, tables: Column, ocr: Column) -> Column:
    """A document's text for extraction: its layer of text, the tables' summary and the text of pictures, under marks."""
    part = lambda mark, c: F.when(strip(text(c)) != "", F.concat(F.lit(f"[{mark}]\n"), strip(text(c))))
    return F.concat_ws("\n\n", F.nullif(strip(text(body)), F.lit("")), part("表格", tables), part("OCR", ocr))


def weakest_sections(sections: DataFrame, scores: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, title, chars, faithfulness, place: sections of `least` characters or more with their scores, the weakest first."""
    rows = sections.select("doc_id", "title", F.length(text("body")).alias("chars")).where(F.col("chars") >= least).join(scores, ["doc_id", "title"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("faithfulness", "title")))


def critic_summary(cases: DataFrame) -> DataFrame:
    """system, rates of clean cases that pass and corrupted ones that are found, their mean, issues a case, and invalid answers."""
    clean, corrupt = F.col("variant") == "clean", F.col("variant") == "corrupt"
    n = lambda c: F.greatest(F.sum(c.cast("int")), F.lit(1))
    passed, caught = F.sum((clean & F.col("passed")).cast("int")) / n(clean), F.sum((corrupt & ~F.col("passed")).cast("int")) / n(corrupt)
    issues = lambda c: F.round(F.sum(F.when(c, F.col("issue_count")).otherwise(0)) / n(c), 3)
    return cases.groupBy("system").agg(
        F.sum(clean.cast("int")).alias("clean_cases"), F.sum(corrupt.cast("int")).alias("corrupt_cases"), F.round(passed, 4).alias("clean_pass_rate"), F.round(caught, 4).alias("corrupt_detect_rate"),
        F.round((passed + caught) / 2, 4).alias("balanced_score"), issues(clean).alias("issues_clean"), issues(corrupt).alias("issues_corrupt"), F.round(F.sum(F.col("invalid").cast("int")) / F.greatest(F.count("*"), F.lit(1)), 4).alias("invalid_rate"),
    )


def normal_answer(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[\s\p{Punct}]+", " "))


def answer_appears(content: Column, answers: Column) -> Column:
    """Whether a text holds one of the answers (of two characters or more), ignoring case, blanks and punctuation."""
    base = normal_answer(content)
    return F.exists(F.transform(answers, normal_answer), lambda a: (F.length(a) >= 2) & F.contains(base, a))


def answer_coverage(samples: DataFrame) -> DataFrame:
    """id, points, covered, coverage of samples (id, content, gold: array of arrays of answers that mean the same)."""
    covered = F.size(F.filter("gold", lambda g: answer_appears(F.col("content"), g)))
    return samples.select("id", F.size("gold").alias("points"), covered.alias("covered"), F.round(covered / F.greatest(F.size("gold"), F.lit(1)), 6).alias("coverage"))


def usable_sample(question: Column, answer: Column, pairs: Column, docs: Column) -> Column:
    """Whether a sample can test: two pairs, eight documents, five of the first 20 with a text, an answer of 120 characters."""
    full = F.size(F.filter(F.slice(docs, 1, 20), lambda d: strip(F.coalesce(d, F.lit(""))) != ""))
    return (text(question) != "") & (F.size(pairs) >= 2) & (F.size(docs) >= 8) & (F.length(text(answer)) >= 120) & (full >= 5)


def corrupted_answer(answer: Column, gold: Column, decoys: Column) -> Column:
    """An answer with the first gold phrase it holds exchanged once for the first decoy that it lacks; else with an unsupported sentence behind it."""
    phrase = F.try_element_at(F.filter(F.flatten(gold), lambda g: (F.length(normal_answer(g)) >= 3) & F.contains(answer, g)), F.lit(1))
    decoy = F.try_element_at(F.filter(decoys, lambda d: (normal_answer(d) != normal_answer(phrase)) & ~F.contains(answer, d)), F.lit(1))
    at = F.position(phrase, answer)
    swapped = F.concat(F.substring(answer, F.lit(1), at - 1), decoy, F.substring(answer, at + F.length(phrase), F.length(answer)))
    return F.coalesce(swapped, F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit(INJECTED)))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns that a chart asks for and the table lacks."""
    have = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() not in have]


def chart(df: DataFrame, kind: str, x: str, y: str, most: int = 7) -> DataFrame:
    """label, value of a chart: line and bar sum y by x, pie the largest `most` and the rest, scatter gives each pair; an error names lacking columns."""
    from .tabular import top_and_others

    if lacking := missing_columns(df, [x, y]):
        raise ValueError(f"the table has no column {', '.join(lacking)}")
    if kind == "pie":
        return top_and_others(df, x, y, most)
    if kind == "scatter":
        return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("label"), F.col(y).cast("double").alias("value"))
    return df.groupBy(F.col(x).alias("label")).agg(F.sum(F.col(y).cast("decimal(38,2)")).cast("double").alias("value"))


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")
