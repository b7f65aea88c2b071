"""Review of generated texts: outlines, sections, claims, verdicts, model answers as text, chat and task housekeeping."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import any_of, hits
from ..functions.text import CJK, jaccard, strip, text, words
from .facts import numbers

# The words that tell kinds of sections, issues and remedies apart.
SECTION_TYPES = {
    "experiment_setup": ["实验设定", "实验设计", "实验设置", "方法", "设置", "数据集", "实现细节", "模型架构", "训练配置", "评测方案", "预处理", "特征工程", "采样", "划分", "验证策略"],
    "data": ["实验", "数据", "结果", "性能", "评估", "测试", "指标", "统计", "对比", "比较", "精度", "准确率", "召回率", "F1", "BLEU", "ROUGE", "消融", "参数", "配置", "超参数", "训练", "推理", "延迟", "吞吐", "baseline", "基线", "对比实验", "定量", "数值", "百分比"],
    "analysis": ["讨论", "分析", "展望", "启示", "建议", "未来", "趋势", "影响", "意义", "价值", "优劣", "权衡", "局限", "不足", "改进方向", "综合", "解读", "思考", "反思", "启示", "对策", "路径"],
}
CONNECTORS = ["接下来", "下面", "下一", "进一步", "在此基础", "基于以上", "承接", "前述", "综上所", "在此背景", "另一方"]
SEVERITIES = {  # the first that holds; 中 without any
    "(虚假|编造|伪造|完全不?存在|严重错误|数据错误|虚构)": "严重",
    "(无依据|找不到|未在.*中[发出]现|无来源|缺乏证据|证据不足)": "轻微",
    "(推测|推断|可能不?准确|疑似|待核实|需确认|无法验证)": "轻微",
    "(夸大|过度|过于绝对|不够精确|模糊|笼统)": "轻微",
    "(部分.*错误|细节.*问题|表述.*不准确|轻微.*偏差)": "轻微",
}
REMEDIES = {  # the first whose word occurs
    "数据": "用源材料中的具体数据替换当前表述，或标注为「估算值」",
    "推测": "添加限定词（如「可能」「据分析」），或引用源材料中的相关观点作为支撑",
    "夸大": "使用源材料中的原始措辞，避免程度副词（如「显著」「大幅」）",
    "缺失": "从知识库检索补充该部分内容，或标注为「待补充」",
    "错误": "直接更正为源材料中的准确信息",
}
REMEDY = "对照源材料修改或删除无依据内容"
FINAL_MARKS = ["Final Answer:", "Final answer:", "FINAL ANSWER:", "最终答案：", "答案：", "回答：", "结论："]
# End of the fixed values.


def section_type(title: Column) -> Column:
    """The kind with most keywords, setup before data before analysis; review without any."""
    n = {k: hits(strip(text(title)), v) for k, v in SECTION_TYPES.items()}
    top = F.greatest(*n.values())
    out = F.when(top == 0, "review")
    for kind, c in n.items():
        out = out.when(c == top, kind)
    return out


def outline_issues(headings: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """doc_id, sections, issues of outlines (doc_id, order_index, level, title)."""
    w = Window.partitionBy("doc_id").orderBy("order_index")
    rows = headings.withColumn("jump", F.col("level") - F.lag("level", 1, 0).over(w) > 1)
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", F.lower(F.trim("title"))).orderBy("order_index")) > 1)
    per = rows.groupBy("doc_id").agg(F.sum((F.col("level") == 2).cast("int")).alias("h2"), F.sum((F.col("level") == 3).cast("int")).alias("h3"), F.max("jump").alias("jump"), F.max("again").alias("again"), F.max(F.length("title") > 40).alias("long"))
    issues = F.array_compact(F.array(F.when(F.col("h2") < least, F.lit("few")), F.when(F.col("h2") > most, F.lit("many")), F.when(F.col("jump"), F.lit("jump")), F.when(F.col("again"), F.lit("repeated")), F.when(F.col("long"), F.lit("long"))))
    return per.select("doc_id", "h2", "h3", issues.alias("issues"))


def topic_coverage(headings: DataFrame, topics: DataFrame) -> DataFrame:
    """doc_id, covered, topics: topics (doc_id, topic) whose words some heading shares."""
    t = topics.select("doc_id", "topic", F.explode(words(F.col("topic"))).alias("w"))
    h = headings.select("doc_id", F.explode(words(F.col("title"))).alias("w")).distinct()
    found = t.join(h, ["doc_id", "w"]).select("doc_id", "topic").distinct().groupBy("doc_id").agg(F.count("*").alias("covered"))
    return topics.groupBy("doc_id").agg(F.count_distinct("topic").alias("topics")).join(found, "doc_id", "left").select("doc_id", F.coalesce("covered", F.lit(0)).alias("covered"), "topics")


def word_budget(headings: DataFrame, total: int) -> DataFrame:
    """headings with words: level 2 and 3 share the total 3 to 1, with 150 and 80 at least."""
    weight = F.when(F.col("level") == 2, 3).when(F.col("level") == 3, 1).otherwise(0)
    unit = F.lit(total) / F.greatest(F.sum(weight).over(Window.partitionBy("doc_id")), F.lit(1))
    least = F.when(F.col("level") == 2, 150).when(F.col("level") == 3, 80).otherwise(0)
    return headings.withColumn("words", F.greatest(F.floor(unit * weight).cast("int"), least))


def point_coverage(points: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, point, coverage: 充足, 有限 or 无, by the best word overlap of a section."""
    pairs = points.join(sections, "doc_id").withColumn("j", jaccard(words(F.col("point")), words(F.col("body"))))
    best = pairs.groupBy("doc_id", "point").agg(F.max("j").alias("j"))
    return best.select("doc_id", "point", F.when(F.col("j") >= 0.3, "充足").when(F.col("j") >= 0.1, "有限").otherwise("无").alias("coverage"))


def title_found(body: Column, title: Column, n: int = 4, window: int = 50) -> Column:
    """Whether the first n characters of a title occur in a text and `window` characters or more follow."""
    at = F.position(F.substring(title, 1, n), body)
    return (at > 0) & (F.length(body) - at - n >= window)


def patch_unverified(c: Column, claims: Column, mark: str = "[数据待核实]") -> Column:
    """Unverified figures replaced, the longer ones first so that none is cut within another."""
    order = F.array_sort(claims, lambda a, b: F.length(b) - F.length(a))
    quote = lambda x: F.concat(F.lit(r"(?<![\d.])\Q"), x, F.lit(r"\E(?![\d.%])"))
    return F.aggregate(order, c, lambda acc, x: F.regexp_replace(acc, quote(x), F.lit(mark.replace("$", r"\$"))))


GENERIC = ["A", "An", "The", "Several", "English", "British", "American", "Original", "Radio", "Television", "Film", "Movie", "Actor", "Actress", "BBC", "He", "She", "They", "It", "This", "That", "These", "Those"]  # fixed: words that are no entity


def heuristic_critic(sections: DataFrame, most: int = 4, first: int = 10) -> DataFrame:
    """doc_id, n, kind, what: of texts with their materials (doc_id, body, materials) the first unsupported figure, else capitalised
    name, of each of the first sentences, `most` in all."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]+", " "))
    sentences = F.filter(F.transform(F.split(text("body"), r"[。！？.!?](?!\d)\s*"), strip), lambda s: s != "")
    rows = sections.select("doc_id", text("materials").alias("materials"), F.posexplode(F.slice(sentences, 1, first)).alias("pos", "s"))
    figure = F.filter(F.regexp_extract_all("s", F.lit(r"\b\d[\d,\.:%-]*\b"), 0), lambda x: ~F.contains(F.col("materials"), x))
    own = F.filter(F.regexp_extract_all("s", F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"), 0), lambda x: ~F.forall(F.split(x, r"\s+"), lambda w: w.isin(GENERIC)))
    name = F.filter(own, lambda x: (F.length(plain(x)) >= 4) & ~F.contains(F.col("known"), plain(x)))
    rows = rows.withColumn("known", plain(F.col("materials"))).select("doc_id", "pos", F.try_element_at(figure, F.lit(1)).alias("figure"), F.try_element_at(name, F.lit(1)).alias("name"))
    found = rows.select("doc_id", "pos", F.when(F.col("figure").isNotNull(), "figure").otherwise("entity").alias("kind"), F.coalesce("figure", "name").alias("what")).where("what IS NOT NULL")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("n") <= most).select("doc_id", "n", "kind", "what")


def critic_lines(answers: DataFrame) -> DataFrame:
    """id, n, type, location, description, severity of a critic's lines `## … | type | location | description | severity` (中 without the last)."""
    rows = answers.select("id", F.posexplode(F.split(text("answer"), "\r?\n")).alias("n", "line")).where(F.trim("line").startswith("##") & F.contains("line", F.lit("|")))
    parts = F.transform(F.split("line", r"\|"), strip)
    part = lambda k, default="": F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(default))
    return rows.where(F.size(parts) >= 4).select("id", "n", part(2).alias("type"), part(3).alias("location"), part(4).alias("description"), part(5, "中").alias("severity"))


def wanted_searches(answer: Column) -> Column:
    """Queries of a critic's last line `@@SEARCH: a, b`."""
    last = F.regexp_extract(text(answer), r"(?is).*(?:^|\n)\s*@@SEARCH:([^\n]*)", 1)
    return F.filter(F.transform(F.split(last, ","), strip), lambda q: q != "")


DIMENSIONS = ["relevance", "faithfulness", "coherence", "completeness"]


def judge_scores(answer: Column) -> Column:
    """struct of the four scores, 0 to 1, of a judge's JSON answer: {"scores": {name: {"score": 1..5}}}, or name: 1..5; 0 where it has none."""
    body = F.regexp_extract(text(answer), r"(?s)(\{.*\})", 1)
    read = lambda path: F.get_json_object(body, path).cast("double")
    score = lambda d: F.coalesce(read(f"$.scores.{d}.score"), read(f"$.scores.{d}"), read(f"$.{d}.score"), read(f"$.{d}"), F.lit(0.0)) / 5
    return F.struct(*[score(d).alias(d) for d in DIMENSIONS])


def citation_accuracy(texts: DataFrame) -> DataFrame:
    """doc_id, total, valid, accuracy of citations (据…) in texts (doc_id, body, sources): valid if half of their words occur in the sources."""
    cites = F.regexp_extract_all(text("body"), F.lit("[（(]据(.+?)[）)]"), 1)
    words_of = lambda c: F.regexp_extract_all(F.lower(strip(c)), F.lit(f"[{CJK}\\p{{L}}\\p{{N}}_]{{2,}}"), 0)
    held = lambda c: F.size(F.filter(words_of(c), lambda w: F.contains(F.col("known"), w)))
    ok = lambda c: (F.size(words_of(c)) > 0) & (held(c) >= F.greatest(F.lit(1), F.floor(F.size(words_of(c)) / 2).cast("int")))
    rows = texts.withColumn("known", F.lower(text("sources")))
    return rows.select("doc_id", F.size(cites).alias("total"), F.size(F.filter(cites, ok)).alias("valid")).withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("valid") / F.col("total"), 6)))


def severities(issues: DataFrame) -> DataFrame:
    """doc_id, severity, issues, fixable: what is not 高 can be fixed."""
    return issues.groupBy("doc_id", "severity").agg(F.count("*").alias("issues"), (F.first("severity") != "高").alias("fixable"))


def severity(issue: Column) -> Column:
    out = F.lit("中")
    for pattern, name in reversed(SEVERITIES.items()):
        out = F.when(text(issue).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def remedy(issue: Column) -> Column:
    out = F.lit(REMEDY)
    for word, advice in reversed(REMEDIES.items()):
        out = F.when(F.contains(text(issue), F.lit(word)), F.lit(advice)).otherwise(out)
    return out


def skip_critic(body: Column, issues: Column) -> Column:
    """Short texts need no review; nor do those under 2000 characters or three sections without an issue."""
    h2 = F.regexp_count(body, F.lit(r"(?m)^##\s"))
    return (F.length(body) < 200) | (((F.length(body) < 2000) | (h2 < 3)) & (issues == 0))


def atomic_facts(content: Column, answer: Column, most: int = 20) -> Column:
    """Facts that a model lists for a text of 100 characters or more: lines of over five characters, `most` of them."""
    lines = F.filter(F.transform(F.split(text(answer), "\r?\n"), strip), lambda x: F.length(x) > 5)
    return F.when(F.length(strip(text(content))) >= 100, F.slice(lines, 1, most)).otherwise(F.array().cast("array<string>"))


def open_aspects(aspects: DataFrame, most: int = 3) -> DataFrame:
    """id, n, terms of the first aspects (id, pos, terms, body) that the body doesn't cover, for a second retrieval."""
    first = F.slice("terms", 1, 3)
    need = F.greatest(F.lit(1), F.floor(F.size(first) / 2).cast("int"))
    rows = aspects.where(F.size(F.filter(first, lambda t: F.contains(F.col("body"), t))) < need)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("n") <= most).select("id", "n", "terms")


def verdicts(answers: DataFrame) -> DataFrame:
    """id, n, ok: lines `3. OK` or `3: MISS` of a model's answer; a fact (id, n of facts) without a line is missed."""
    lines = answers.select("id", "facts", F.explode(F.split(text("answer"), "\n")).alias("line"))
    found = lines.select("id", F.regexp_extract("line", r"^\s*(\d+)", 1).alias("n"), F.col("line").rlike(r"(?i)\bOK\b").alias("ok")).where("n <> ''").select("id", F.col("n").cast("int").alias("n"), "ok")
    every = answers.select("id", F.explode(F.sequence(F.lit(1), F.col("facts"))).alias("n"))
    return every.join(found.groupBy("id", "n").agg(F.max("ok").alias("ok")), ["id", "n"], "left").select("id", "n", F.coalesce("ok", F.lit(False)).alias("ok"))


def factscore(found: DataFrame) -> DataFrame:
    """id, score: the share of verified facts."""
    return found.groupBy("id").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("score"))


def aspect_coverage(aspects: DataFrame) -> DataFrame:
    """id, coverage: aspects (id, terms, body) are covered if half of their first three terms, one at least, occur."""
    first = F.slice("terms", 1, 3)
    need = F.greatest(F.lit(1), F.floor(F.size(first) / 2).cast("int"))
    ok = F.size(F.filter(first, lambda t: F.contains(F.col("body"), t))) >= need
    return aspects.groupBy("id").agg(F.round(F.avg(ok.cast("double")), 6).alias("coverage"))


def consistency(pairs: DataFrame) -> DataFrame:
    """doc_id, score: 1 - flagged / neighbouring pairs (doc_id, flag)."""
    return pairs.groupBy("doc_id").agg(F.round(1 - F.avg(F.col("flag").cast("double")), 6).alias("score"))


def issue_lines(answers: DataFrame) -> DataFrame:
    """id, n, kind, message of lines `##kind|message` and `@@SEARCH: query` of a model's answer."""
    rows = answers.select("id", F.posexplode(F.split(text("answer"), "\n")).alias("n", "line"))
    a = rows.where(F.col("line").rlike(r"^##[^|]+\|")).select("id", "n", strip(F.regexp_extract("line", r"^##([^|]+)\|(.*)$", 1)).alias("kind"), strip(F.regexp_extract("line", r"^##([^|]+)\|(.*)$", 2)).alias("message"))
    b = rows.where(F.col("line").rlike("^@@SEARCH:")).select("id", "n", F.lit("search").alias("kind"), strip(F.regexp_extract("line", "^@@SEARCH:(.*)$", 1)).alias("message"))
    return a.unionByName(b)


def plan_lines(answers: DataFrame) -> DataFrame:
    """id, n, task, needs, priority of lines `- task | needs | priority`; priority 中 if none is given."""
    rows = answers.select("id", F.posexplode(F.split(text("answer"), "\n")).alias("n", "line")).where(F.col("line").rlike(r"^\s*[-*]\s+\S"))
    parts = F.transform(F.split(F.regexp_replace("line", r"^\s*[-*]\s+", ""), r"\|"), strip)
    part = lambda k, default: F.coalesce(F.nullif(F.try_element_at(parts, F.lit(k)), F.lit("")), F.lit(default))
    return rows.select("id", "n", part(1, "").alias("task"), part(2, "").alias("needs"), part(3, "中").alias("priority"))


def final_answer(c: Column, markers: list[str] = FINAL_MARKS) -> Column:
    """What follows the last of the markers; '' if there is none."""
    pattern = "(?s)^.*(?:" + "|".join(rf"\Q{m}\E" for m in markers) + ")"
    return F.when(text(c).rlike(pattern), strip(F.regexp_replace(text(c), pattern, ""))).otherwise("")


def split_questions(c: Column, most: int = 6, chars: int = 240) -> Column:
    """A model's questions, one a line: numbers and bullets go, lines A. to Z. are options of the question before them.

    A blank line ends a question. Without any the whole text is one.
    """
    option = lambda x: x.rlike(r"^[A-Z][.)、\s]")
    bare = lambda x: F.substring(strip(F.regexp_replace(strip(F.regexp_replace(x, r"^[0-9]+[.)、\s]+", "")), r"^[-*]\s+", "")), 1, chars)

    def line(acc: Column, x: Column) -> Column:
        joins = option(x) & (acc["held"] != "")
        out = F.when(joins | (acc["held"] == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"])))
        held = F.when(joins, F.concat(acc["held"], F.lit("\n"), x)).when(x == "", "").otherwise(bare(x))
        return F.struct(out.alias("out"), held.alias("held"))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    lines = F.transform(F.split(text(c), "\r?\n"), strip)
    found = F.aggregate(lines, zero, line, lambda acc: F.when(acc["held"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["held"]))))
    whole = F.substring(strip(text(c)), 1, chars)
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))


def transitions(sections: DataFrame) -> DataFrame:
    """doc_id, order_index, has_transition: whether the section before ends with a connecting word in its last two sentences."""
    w = Window.partitionBy("doc_id").orderBy("order_index")
    rows = sections.withColumn("before", F.lag("body").over(w))
    parts = F.split(strip(text("before")), r"[。！？\n](?=\s*\S)")
    last = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "")
    return rows.select("doc_id", "order_index", any_of(last, CONNECTORS).alias("has_transition"))


def subtree_end(headings: DataFrame) -> DataFrame:
    """headings with end_index: where the next heading of the same or a smaller level stands, null at the end."""
    a = headings.select("doc_id", "order_index", "level", "title")
    rows = Window.partitionBy("doc_id").orderBy("order_index").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col("level") <= n, F.col("order_index"))).over(rows) for n in range(1, 7)]
    return a.withColumn("end_index", F.array(*nexts)[F.col("level") - 1])


def replace_section(sections: DataFrame, new: DataFrame) -> DataFrame:
    """Bodies replaced by those of `new` (doc_id, order_index, body); an empty one keeps the old."""
    n = new.select("doc_id", "order_index", F.col("body").alias("new__"))
    return sections.join(n, ["doc_id", "order_index"], "left").withColumn("body", F.coalesce(F.nullif(F.trim("new__"), F.lit("")), "body")).drop("new__")


def regenerate(sections: DataFrame, targets: DataFrame, new: DataFrame) -> DataFrame:
    """Sections (doc_id, order_index, level, title, body) with new bodies (doc_id, order_index, body) for targets (doc_id,
    order_index) and what stands under them; others keep theirs, as do those whose new body is empty."""
    ends = subtree_end(sections).join(targets, ["doc_id", "order_index"]).select("doc_id", F.col("order_index").alias("from__"), F.coalesce("end_index", F.lit(1 << 30)).alias("to__"))
    spans = ends.groupBy("doc_id").agg(F.collect_list(F.struct("from__", "to__")).alias("spans__"))
    within = F.exists(F.coalesce("spans__", F.array().cast("array<struct<from__:int,to__:int>>")), lambda s: (F.col("order_index") >= s["from__"]) & (F.col("order_index") < s["to__"]))
    rows = sections.join(new.select("doc_id", "order_index", F.col("body").alias("new__")), ["doc_id", "order_index"], "left").join(spans, "doc_id", "left")
    return rows.withColumn("body", F.when(within, F.coalesce(F.nullif(F.trim("new__"), F.lit("")), "body")).otherwise(F.col("body"))).select(*sections.columns)


def changed_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """title, change: added, modified or removed, by the hash of the body."""
    a, b = old.select("doc_id", "title", F.md5("body").alias("a")), new.select("doc_id", "title", F.md5("body").alias("b"))
    rows = a.join(b, ["doc_id", "title"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return rows.select("doc_id", "title", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified").alias("change"))


def resolve_kb(messages: DataFrame, names: DataFrame) -> DataFrame:
    """id, kb: the longest known name that a message holds, by an equi-join on the message's own pieces."""
    most = 30
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("message"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.substr(F.col("message"), i, n))))
    rows = messages.select("id", F.explode(F.array_distinct(pieces)).alias("kb")).join(names.select("kb").distinct(), "kb")
    best = rows.groupBy("id").agg(F.max_by("kb", F.struct(F.length("kb"), "kb")).alias("kb"))
    return messages.select("id").join(best, "id", "left")


def retrieval_metrics(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg at k of ranked documents against relevant ones (query_id, doc_id)."""
    hits = found.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return judged_metrics(hits, relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"), F.count("*").alias("listed")), k)


def judged_metrics(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg of hits (query_id, rank, doc_id, hit) and totals (query_id, n relevant documents, listed entries).

    A document that is found twice gains twice, and the ideal has as many gains as entries are listed, so ndcg may exceed 1;
    mrr takes the first relevant rank wherever it is.
    """
    top = (F.col("rank") <= k) & F.col("hit")
    got = hits.groupBy("query_id").agg(
        F.count_distinct(F.when(top, F.col("doc_id"))).alias("g"), F.count_distinct(F.when(F.col("rank") <= k, F.col("doc_id"))).alias("d"),
        F.max(F.when(F.col("hit"), 1.0 / F.col("rank"))).alias("mrr"), F.sum(F.when(top, 1.0 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("listed"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return totals.join(got, "query_id", "left").select("query_id", r(F.col("g") / F.col("n")).alias("recall"), r(F.col("g") / F.nullif(F.col("d"), F.lit(0))).alias("precision"), r(F.col("mrr")).alias("mrr"), r(F.col("dcg") / ideal).alias("ndcg"))


def pipeline(rows: DataFrame, steps: list, parallel: bool = False) -> DataFrame:
    """Quality steps, DataFrame functions over (doc_id, content, warnings): one after another, or side by side, when the
    last that changed the content wins and warnings add up."""
    if not parallel:
        return reduce(lambda df, step: step(df), steps, rows)
    out = rows.select("doc_id", F.col("content").alias("base"), "content", "warnings")
    for step in steps:
        made = step(rows).select("doc_id", F.col("content").alias("c__"), F.col("warnings").alias("w__"))
        out = out.join(made, "doc_id").select("doc_id", "base", F.when(F.col("c__") != F.col("base"), F.col("c__")).otherwise(F.col("content")).alias("content"), F.array_union("warnings", "w__").alias("warnings"))
    return out.drop("base")


def tree_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two HTML tables by their tags and texts in order."""
    import re
    from difflib import SequenceMatcher

    cut = lambda s: re.findall(r"</?\w+|[^<>\s]+", s or "")
    return pd.Series([SequenceMatcher(None, cut(x), cut(y), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def is_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")
