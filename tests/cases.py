"""Rules over small literal tables whose results are worked out by hand. They are tests only, none is a registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import metrics as M
from textloom.functions import query as Q
from textloom.functions import text as X
from textloom.operators import answering, chunking, context, drafts, facts, layout, matching, records, relevance, review, search, similar, tabular
from textloom.plans.catalog import Tables, sql_value

Maker = Callable[[Tables], DataFrame]
CASES: dict[str, tuple[Maker, str]] = {}


def query(sql: str):
    """Adds f(tables) with the SQL of its rows."""

    def add(f: Maker) -> Maker:
        CASES[f.__name__] = (f, sql)
        return f

    return add


def expect(columns: str, rows: list[tuple]):
    """Registers a query whose rows are those given; columns: name and SQL type of each."""
    names, kinds = zip(*(c.split(" ", 1) for c in columns.split(", ")), strict=True)
    head = ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True))
    values = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)
    return query(f"SELECT {head} FROM (VALUES {values}) AS v({', '.join(names)})")


def table(t: Tables, schema: str, rows: list[tuple]) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


def each(t: Tables, texts: list, f, name: str = "x", kind: str = "string") -> DataFrame:
    """id (from 0) and f of each text."""
    return table(t, f"id int, s {kind}", list(enumerate(texts))).select("id", f(F.col("s")).alias(name))


# questions and messages


@expect("id INT, c DOUBLE, k INT", [(0, 0.0, 84), (1, 1.0, 39), (2, 0.5, 60), (3, 0.5, 30), (4, 0.5, 96)])
def profile_cases(t: Tables) -> DataFrame:
    texts = ["为什么会有这种趋势", "流程和金额", "天气", "RAG 2024", "天" * 61]
    return table(t, "id int, s string", list(enumerate(texts))).select("id", Q.concreteness(F.col("s")).alias("c"), M.adaptive_k(F.col("s")).alias("k"))


@expect("id INT, kind VARCHAR", [(0, "fact_lookup"), (1, "conceptual"), (2, "comparison"), (3, "summary"), (4, "how_to"), (5, "fact_lookup"), (6, "multi_document")])
def classify_cases(t: Tables) -> DataFrame:
    rows = [("多少", None), ("什么是检索增强", None), ("两个方案的区别在哪", None), ("汇总一下各部门意见", None), ("报销怎么办理呢", None), ("2024年研发投入占比", "nonsense"), ("各文件里的研发投入", " Multi_Document ")]
    return table(t, "id int, q string, model string", [(k, *r) for k, r in enumerate(rows)]).select("id", Q.classify(F.col("q"), F.col("model")).alias("kind"))


INTENTS = [
    ("查看当前状态", True, False, "control_task"), ("暂停一下", True, False, "control_task"), ("重新生成报告", True, False, "control_task"), ("切换到产品知识库", False, False, "control_task"),
    ("在产品知识库里查一下 RAG 是什么", False, False, "control_task"), ("先别用知识库了", False, False, "control_task"), ("什么是RAG", False, False, "kb_query"), ("请把第三章展开一点，增加案例", True, False, "modify_report"),
    ("你好", True, False, "general_chat"), ("/help", False, False, "control_task"), ("/unknown", False, False, "general_chat"), ("预算是三百万", False, True, "clarify_answer"), ("", False, False, "general_chat"),
]


@expect("id INT, intent VARCHAR", [(k, x[3]) for k, x in enumerate(INTENTS)])
def intent_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, m string, report boolean, asks boolean", [(k, *x[:3]) for k, x in enumerate(INTENTS)])
    return rows.select("id", Q.intent(F.col("m"), F.col("report"), F.col("asks")).alias("intent"))


@expect("id INT, type VARCHAR, kb VARCHAR, question VARCHAR", [(0, "kb_use", "产品", ""), (1, "kb_ask", "产品", "RAG 是什么"), (2, "kb_create", "项目复盘", ""), (3, "kb_clear", "", ""), (4, "kb_delete", "旧", ""), (5, "kb_list", "", ""), (6, "none", "", "")])
def kb_action_cases(t: Tables) -> DataFrame:
    texts = ["切换到产品知识库", "在产品知识库里查一下 RAG 是什么", "新建一个项目复盘知识库", "先别用知识库了", "删除旧知识库", "有哪些知识库", "今天天气"]
    return each(t, texts, Q.kb_action).select("id", "x.type", "x.kb", "x.question")


@expect("id INT, kind VARCHAR", [(0, "empty"), (1, "short"), (2, None), (3, "noise"), (4, "greeting"), (5, "thanks"), (6, None)])
def trivial_cases(t: Tables) -> DataFrame:
    return each(t, ["  ", "测试", "好", "testing", "Hello", "谢谢你", "第二章的数据从哪里来"], Q.trivial, "kind")


@expect("id INT, complex BOOLEAN, hypothesis BOOLEAN", [(0, False, False), (1, True, False), (2, True, True), (3, True, False)])
def gate_cases(t: Tables) -> DataFrame:
    texts = ["今年预算多少", "为什么涨价", "请分析今年研发投入占比下降的原因", "数" * 61]
    return table(t, "id int, s string", list(enumerate(texts))).select("id", Q.is_complex(F.col("s")).alias("complex"), Q.wants_hypothesis(F.col("s")).alias("hypothesis"))


@expect("id INT, found VARCHAR", [(0, "2024年5月3日|2024年5月|12.5%"), (1, "RMB 300|RMB|GB"), (2, "第三章|年度总结"), (3, "TCP|IP4|TCP/IP4")])
def entity_cases(t: Tables) -> DataFrame:
    texts = ["到2024年5月3日增长12.5%", "RMB 300 与 GB 标准", "见第三章“年度总结”", "TCP/IP4"]
    return each(t, texts, lambda c: F.array_join(Q.entities(c), "|"), "found")


@expect("id INT, queries VARCHAR", [(0, "multi hop RAG|multi hop|multi hop rag|multi"), (1, "GPU|gpu|GPU技术"), (2, "")])
def expanded_query_cases(t: Tables) -> DataFrame:
    return each(t, ["multi hop RAG", "GPU", "  "], lambda c: F.array_join(Q.expanded(c), "|"), "queries")


@expect("id INT, queries VARCHAR", [(0, "cache design|design|cache|KV|kv|KV cache 对比实验|cache design 对比实验|KV cache 基线比较")])
def point_query_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, kp string, title string", [(0, "cache design", "KV cache")])
    return rows.select("id", F.array_join(Q.point_queries(F.col("kp"), F.col("title")), "|").alias("queries"))


@expect("id INT, rewritten VARCHAR, variants VARCHAR, parts VARCHAR, hypothesis VARCHAR, doc_type VARCHAR, year VARCHAR", [
    (0, "短问题", "短问题", "短问题", "短问题", None, None),
    (1, "费用报销流程的具体步骤", "报销流程步骤|报销材料清单", "那个报销到底要怎么搞才能尽快拿到钱呢", "报销先填单据再由部门主管审批，最后由财务付款", "制度", "2024"),
    (2, "比较两种方案的成本以及它们各自的风险有哪些", "比较两种方案的成本以及它们各自的风险有哪些", "第一种方案的成本|第二种方案的风险", "比较两种方案的成本以及它们各自的风险有哪些", None, None),
])
def model_answer_gates(t: Tables) -> DataFrame:
    """What a model's rewriting, variants, parts, hypothetical text and filters become, by the length of question and answer."""
    rows = table(t, "id int, q string, r string, v string, d string, h string, f string", [
        (0, "短问题", "更长的改写文本", "1. 变体一号", "1. 子问题一二三", "一个足够长的假设性回答文本内容", "{}"),
        (1, "那个报销到底要怎么搞才能尽快拿到钱呢", "费用报销流程的具体步骤", "1. 报销流程步骤\n2) 报销材料清单\n3、报销流程步骤\n短", "SIMPLE", "报销先填单据再由部门主管审批，最后由财务付款", '{"doc_type": " 制度 ", "time_range": "2024"}'),
        (2, "比较两种方案的成本以及它们各自的风险有哪些", "短", "", "1. 第一种方案的成本\n2. 第二种方案的风险\n3. 短", "太短", "not json"),
    ])
    q = F.col("q")
    filters = Q.metadata_filters(q, F.col("f"))
    return rows.select("id", Q.rewritten(q, F.col("r")).alias("rewritten"), F.array_join(Q.variants(q, F.col("v")), "|").alias("variants"), F.array_join(Q.subquestions(q, F.col("d")), "|").alias("parts"), Q.hypothesis(q, F.col("h")).alias("hypothesis"), filters["doc_type"].alias("doc_type"), filters["time_range"].alias("year"))


@expect("id INT, route VARCHAR, size INT", [(0, "multi_query|stepback|hyde", 24), (1, "multi_query", 6), (2, "stepback", 6), (3, "rewritten", 18)])
def route_cases(t: Tables) -> DataFrame:
    texts = ["什么是检索增强", "两个方案的区别在哪", "汇总一下各部门意见", "2024年研发投入占比"]
    return table(t, "id int, q string", list(enumerate(texts))).select("id", F.array_join(answering.route(F.col("q")), "|").alias("route"), answering.route_size(F.col("q"), 6).alias("size"))


@expect("id INT, questions VARCHAR", [(0, "报告给谁看？\nA. 领导\nB. 客户#篇幅多长"), (1, "第一问#第二问#第三问"), (2, "只有一句话"), (3, "a#b#c#d#e#f"), (4, "")])
def question_split_cases(t: Tables) -> DataFrame:
    texts = ["1. 报告给谁看？\nA. 领导\nB. 客户\n\n2) 篇幅多长", "- 第一问\n* 第二问\n3、第三问", "只有一句话", "\n".join("abcdefgh"), None]
    return each(t, texts, lambda c: F.array_join(review.split_questions(c), "#"), "questions")


@expect("id INT, answer VARCHAR", [(0, "四十二"), (1, ""), (2, "B"), (3, "")])
def final_answer_cases(t: Tables) -> DataFrame:
    return each(t, ["先想想。最终答案：四十二", "没有标记的文本", "Final Answer: A\n结论： B ", None], review.final_answer, "answer")


# texts


@expect("id INT, x VARCHAR", [(0, "95.3"), (1, "1200"), (2, "3.5"), (3, "三"), (4, "40"), (5, "")])
def number_cases(t: Tables) -> DataFrame:
    return each(t, ["约95.3%", "超过 1200万元", "3.5亿", "三百", " 至少40 小时 ", None], X.normalize_number)


@expect("id INT, field VARCHAR, value VARCHAR", [(0, "DATE OF BIRTH", "date of birth"), (1, "ROOM 12 B", "Room 12 B"), (2, "", "")])
def form_text_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, s string", [(0, " date_of-birth: "), (1, "Room12B"), (2, " -: ")])
    return rows.select("id", X.form_text(F.col("s"), True).alias("field"), X.form_text(F.col("s")).alias("value"))


@expect("id INT, x VARCHAR", [(0, "1200 Main Street, Suite 5"), (1, "500 N. W., Washington Ave, Apt 3"), (2, "")])
def address_cases(t: Tables) -> DataFrame:
    texts = ["Ship to:\n1200  Main Street,Suite 5 ,\n1200 Main Street, Suite 5", "500 N.W. Washington Ave,Apt 3", "12 Short St\nno number street here at all"]
    return each(t, texts, lambda c: F.array_join(X.addresses(c), "#"))


@expect("id INT, x VARCHAR", [(0, "知识|识库|RAG|GPT-4"), (1, "the|cat")])
def keyword_cases(t: Tables) -> DataFrame:
    return each(t, ["知识库 RAG GPT-4", "the The cat"], lambda c: F.array_join(F.filter(X.keywords(c), lambda w: w != "GPT"), "|"))


@expect("id INT, x VARCHAR", [(0, "short"), (1, "一二三四五六七。\n…"), (2, "一二三四五六七八九十…")])
def cut_cases(t: Tables) -> DataFrame:
    return each(t, ["short", "一二三四五六七。九十一二", "一二三四五六七八九十一二"], lambda c: X.cut_block(c, 10))


@expect("id INT, x VARCHAR", [(0, "1200万|35|NEV|增长 35%"), (1, "")])
def key_entity_cases(t: Tables) -> DataFrame:
    return each(t, ["NEV销量1200万台，增长 35%", "没有数字"], lambda c: F.array_join(X.key_entities(c), "|"))


@expect("id INT, merged VARCHAR, best VARCHAR", [(0, "Invoice No: 1\nTotal: 5\nThanks", "Invoice No: 1\nTotal: 5"), (1, "only", "only")])
def ocr_text_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, a string, b string", [(0, "Invoice No: 1\nTotal: 5", "invoice  no: 1\nx\nThanks"), (1, "", "only")])
    return rows.select("id", X.merge_lines(F.col("a"), F.col("b")).alias("merged"), X.best_text(F.col("a"), F.col("b")).alias("best"))


@expect("id INT, tokens VARCHAR", [(0, "知识|识库|管理"), (1, "rag|技术|2024"), (2, "单")])
def token_cases(t: Tables) -> DataFrame:
    """CJK runs as pairs, of which a lone character is one."""
    return each(t, ["知识库，管理", "RAG技术2024", "单"], lambda c: F.array_join(X.tokens(c), "|"), "tokens")


@expect("doc_id INT, term VARCHAR, tf BIGINT, rank INT", [(1, "知识", 3, 1), (1, "识库", 2, 2), (1, "rag", 1, 3)])
def cjk_term_frequency(t: Tables) -> DataFrame:
    rows = table(t, "doc_id int, s string", [(1, "知识库 RAG 知识库 知识")])
    return facts.term_frequency(rows, X.tokens(F.col("s")), 3)


@expect("query_id INT, chunk_id VARCHAR, bm25 DOUBLE", [(1, "a", round(0.6931471805599453 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5)), 6)), (1, "b", 0.0)])
def bm25_cases(t: Tables) -> DataFrame:
    """One of two chunks holds the pair twice: idf is ln(1.5 / 1.5 + 1), the mean length 2.5."""
    rows = table(t, "query_id int, chunk_id string, content string", [(1, "a", "知识 知识 库存"), (1, "b", "其他 文本")])
    return search.bm25(rows, table(t, "query_id int, query string", [(1, "知识")]))


@expect("id INT, n INT, words VARCHAR", [(0, 5, "W:ab|cd"), (1, 0, "")])
def fingerprint_cases(t: Tables) -> DataFrame:
    """Trigrams abc, bcd, cde, def, and the pair of the two words of two characters or more."""
    f = X.fingerprint(F.col("s"))
    return table(t, "id int, s string", [(0, "AB cd  e f"), (1, None)]).select("id", F.size(f).alias("n"), F.array_join(F.filter(f, lambda x: x.startswith("W:")), "&").alias("words"))


@expect("id INT, similarity DOUBLE", [(0, 1.0), (1, 0.75), (2, 0.5), (3, 0.0)])
def similarity_cases(t: Tables) -> DataFrame:
    """Equal tokens in another order; three of four characters in common; two of four tokens and no long block; nothing."""
    rows = table(t, "id int, a string, b string", [(0, "RAG 知识", "知识 rag"), (1, "abcd", "abce"), (2, "ab cd ef", "ef zz ab"), (3, "ab", "cd")])
    return rows.select("id", F.round(matching.text_similarity("a", "b"), 6).alias("similarity"))


# findings in texts


@expect("id INT, severity VARCHAR, remedy VARCHAR", [
    (0, "严重", review.REMEDIES["数据"]), (1, "轻微", review.REMEDY), (2, "轻微", review.REMEDIES["推测"]), (3, "轻微", review.REMEDIES["夸大"]), (4, "中", review.REMEDIES["缺失"]), (5, "轻微", review.REMEDIES["错误"]), (6, "中", review.REMEDY),
])
def severity_cases(t: Tables) -> DataFrame:
    texts = ["数据错误且属于编造", "该结论无依据", "属于推测", "表述过于夸大", "内容缺失", "部分引用错误", "其他"]
    return table(t, "id int, s string", list(enumerate(texts))).select("id", review.severity(F.col("s")).alias("severity"), review.remedy(F.col("s")).alias("remedy"))


FIELDS = [
    ("Contact", "a.b@example.com", "EMAIL"), ("Issued", "03/04/2021", "DATE"), ("When", "12 Sept 1999", "DATE"), ("TEL", "ext 12", "PHONE"), ("Code", "555 123 4567", "PHONE"), ("Total", "$ 45.20", "AMOUNT"),
    ("Note", "$ 45.20", "TEXT"), ("Where", "221 baker street", "ADDRESS"), ("Where", "12号中山 路", "ADDRESS"), ("Who", "Ada Lovelace", "NAME"), ("Who", "ada lovelace", "TEXT"), ("x", None, "TEXT"),
]


@expect("id INT, kind VARCHAR", [(k, x[2]) for k, x in enumerate(FIELDS)])
def field_type_cases(t: Tables) -> DataFrame:
    return table(t, "id int, f string, v string", [(k, *x[:2]) for k, x in enumerate(FIELDS)]).select("id", Q.field_type(F.col("f"), F.col("v")).alias("kind"))


@expect("id INT, claims VARCHAR", [(0, "优于:本方法的精度:基线模型的结果"), (1, "高于:今年的总收入:去年的总收入"), (2, "相比更:新方案的成本:旧方案的成本"), (3, "")])
def contrast_cases(t: Tables) -> DataFrame:
    texts = ["本方法的精度优于基线模型的结果\n本方法的精度优于基线模型的结果", "今年的总收入高于去年的总收入", "新方案的成本相比旧方案的成本更低一些而已", "短优于短"]
    return each(t, texts, lambda c: F.array_join(F.transform(facts.contrastive(c), lambda x: F.concat_ws(":", x["kind"], x["left"], x["right"])), "#"), "claims")


CITED = [
    ("没有标记", "missing"), ("据公司年报显示收入增长【1】", "few,bare"), ("【1】据年报收入增长【2】", ""), ("甲【1】乙【1】\n丙【2】", "repeated"), ("见[3]的结果", "none,half-width"), ("甲【1】乙【21】", "range"), ("甲【1】乙【2】后续工作", "style"),
]


@expect("id INT, issues VARCHAR", [(k, x[1]) for k, x in enumerate(CITED)])
def citation_cases(t: Tables) -> DataFrame:
    return each(t, [x[0] for x in CITED], lambda c: F.array_join(facts.citation_issues(c), ","), "issues")


@expect("doc_id INT, text VARCHAR", [(1, "甲【1】乙【2】丙【1】"), (2, "无")])
def renumber_cases(t: Tables) -> DataFrame:
    return facts.renumber_text(table(t, "doc_id int, text string", [(1, "甲【7】乙【3】丙【7】"), (2, "无")]))


@expect("doc_id INT, refs VARCHAR", [(1, "【1】a\n【2】b.txt")])
def reference_cases(t: Tables) -> DataFrame:
    rows = table(t, "doc_id int, section int, local_id int, source string, chunk_id string", [(1, 1, 1, "kb/a.pdf", "a1"), (1, 1, 2, "b.txt", "b1"), (1, 2, 1, "kb/a.pdf", "a2"), (1, 2, 2, "kb/a.pdf", "a1")])
    return facts.reference_list(facts.global_citations(rows)).select("doc_id", F.col("references").alias("refs"))


@expect("doc_id INT, pos INT, old_id INT, issue VARCHAR", [(1, 1, 2, "no_entity_overlap"), (1, 2, 9, "fake_citation")])
def suspicious_citation_cases(t: Tables) -> DataFrame:
    filler = "某" * 120
    texts = table(t, "doc_id int, text string", [(1, f"销量达到1200台【1】{filler}价格稳定【2】{filler}其他【9】")])
    sources = table(t, "doc_id int, old_id int, snippet string", [(1, 1, "全年1200台"), (1, 2, "增幅为88.5"), (1, 3, "无关")])
    return facts.suspicious_citations(texts, sources)


@expect("id INT, found VARCHAR", [(0, "据统计:未指明具体报告名称|有研究表明:未指明研究/学者名称"), (1, ""), (2, "据悉:使用了不确定来源的引述"), (3, "据统计:未指明具体报告名称")])
def vague_citation_cases(t: Tables) -> DataFrame:
    texts = ["据统计增长。有研究表明下降", "（据年报，有研究表明下降）", "据悉，价格上涨", "增长（据统计年鉴）"]
    return each(t, texts, lambda c: F.array_join(F.transform(drafts.vague_citations(c), lambda x: F.concat_ws(":", x["text"], x["reason"])), "|"), "found")


@expect("id BIGINT, fact VARCHAR", [(1, "92.1%"), (2, "2021")])
def unsupported_number_cases(t: Tables) -> DataFrame:
    rows = [(1, "正文", "准确率95.3%，另称92.1%"), (1, "材料", "准确率95.3%"), (2, "正文", "2021 年 30 家"), (2, "材料", "2020 年 30 家")]
    found = table(t, "id long, kind string, s string", rows).select("id", "kind", F.explode(facts.numbers(F.col("s"))).alias("fact"))
    return facts.unsupported(found.where("kind = '正文'").select("id", "fact"), found.where("kind = '材料'").select("id", "fact"))


@expect("metric VARCHAR, docs BIGINT, low DOUBLE, high DOUBLE", [("准确率", 2, 92.1, 95.3)])
def conflict_cases(t: Tables) -> DataFrame:
    """95.3 and 92.1 of one metric conflict; 95.3 and 95.2 are within a hundredth; one document alone is no conflict."""
    rows = [("准确率", "a", 95.3), ("准确率", "b", 92.1), ("召回率", "a", 95.3), ("召回率", "b", 95.2), ("精度", "a", 1.0), ("精度", "a", 2.0)]
    return facts.conflicts(table(t, "metric string, doc_id string, value double", rows))


@expect("doc_id BIGINT, pos INT, field VARCHAR, value VARCHAR", [(1, 0, "TO", "Smith"), (1, 1, "日期", "2024-01-02"), (1, 2, "Amount", "12.50")])
def key_value_cases(t: Tables) -> DataFrame:
    """A colon of either width or two blanks part a pair; a pair that differs by case only counts once."""
    return facts.key_values(table(t, "doc_id long, text string", [(1, "TO: Smith\n日期：2024-01-02\nAmount  12.50\nto: SMITH\nno pair here")]))


@expect("doc_id BIGINT, order_index INT, level INT, title VARCHAR, parent_title VARCHAR", [(1, 0, 1, "A", ""), (1, 1, 2, "B", "A"), (1, 2, 3, "C", "B"), (1, 3, 2, "D", "A"), (1, 4, 1, "E", ""), (1, 5, 3, "F", "E")])
def outline_cases(t: Tables) -> DataFrame:
    return facts.outline(table(t, "doc_id long, text string", [(1, "# A\ntext\n## B\n### C\n## D\n# E\n### F\n#not one")]))


@expect("doc_id BIGINT, order_index INT, number VARCHAR", [(1, 0, ""), (1, 1, "1"), (1, 2, "1.1"), (1, 3, "2"), (2, 0, "1"), (2, 1, "1.1"), (2, 2, "2")])
def numbering_cases(t: Tables) -> DataFrame:
    texts = [(1, "# A\n## B\n### C\n## D"), (2, "# A\n## B\n# C")]
    return facts.numbered(facts.outline(table(t, "doc_id long, text string", texts))).select("doc_id", "order_index", "number")


@expect("anchor VARCHAR, name VARCHAR, r DOUBLE", [("b", "a", 1.0), ("b", "c", -1.0)])
def correlation_cases(t: Tables) -> DataFrame:
    """b has the largest variance and is the anchor; d is unrelated."""
    return tabular.correlations(table(t, "a double, b double, c double, d double", [(1.0, 10.0, 3.0, 1.0), (2.0, 20.0, 2.0, 2.0), (3.0, 30.0, 1.0, 1.0)]), ["a", "b", "c", "d"])


@expect("name VARCHAR, n BIGINT, mean DOUBLE, median DOUBLE, sd DOUBLE, low DOUBLE, high DOUBLE", [("a", 4, 2.5, 2.5, 1.29, 1.0, 4.0), ("b", 3, 4.0, 2.0, 5.29, 0.0, 10.0)])
def describe_cases(t: Tables) -> DataFrame:
    return tabular.describe(table(t, "a int, b double, c double", [(1, 0.0, None), (2, None, None), (3, 10.0, None), (4, 2.0, None)]), ["a", "b", "c"])


# outlines, drafts, critics


HEADS = [(1, 0, 1, "题"), (1, 1, 2, "1. 背景"), (1, 2, 3, "1.1 数据来源说明"), (1, 3, 2, "方法与实验设计甲"), (1, 4, 2, "方法与实验设计乙"), (1, 5, 2, "不足与风险"), (1, 6, 3, "误差约5%"), (2, 0, 2, "结果"), (2, 1, 2, "市场规模变化"), (2, 2, 2, "政策走向观察")]


def _heads(t: Tables) -> DataFrame:
    return table(t, "doc_id int, order_index int, level int, title string", HEADS)


@expect("doc_id INT, order_index INT, issue VARCHAR", [(1, 1, "short"), (1, 1, "template"), (1, 3, "alike"), (2, 0, "short")])
def naming_cases(t: Tables) -> DataFrame:
    return drafts.naming_issues(_heads(t))


@expect("doc_id INT, issue VARCHAR", [(1, None), (2, "missing")])
def critical_section_cases(t: Tables) -> DataFrame:
    return drafts.critical_issue(_heads(t))


@expect("doc_id INT, h2 BIGINT, h3 BIGINT, headings BIGINT, templates BIGINT, emptiness DOUBLE", [(1, 4, 2, 6, 1, 0.1667), (2, 3, 0, 3, 0, 0.0)])
def outline_metric_cases(t: Tables) -> DataFrame:
    return drafts.outline_metrics(_heads(t))


@expect("id INT, verdict VARCHAR", [(0, "retry_structure"), (1, "retry_coverage"), (2, "retry_coverage"), (3, "accept_with_warnings"), (4, "accept")])
def outline_verdict_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, s int, m int, c double, w int", [(0, 1, 0, 1.0, 0), (1, 0, 2, 1.0, 0), (2, 0, 0, 0.4, 0), (3, 0, 0, 0.9, 2), (4, 0, 0, 0.5, 0)])
    return rows.select("id", drafts.outline_verdict(F.col("s"), F.col("m"), F.col("c"), F.col("w")).alias("verdict"))


@expect("doc_id INT, attempt INT, verdict VARCHAR", [(1, 2, "accept"), (2, 2, "retry_coverage")])
def accepted_outline_cases(t: Tables) -> DataFrame:
    rows = [(1, 1, "x", "retry_structure"), (1, 2, "y", "accept"), (2, 1, "x", "retry_structure"), (2, 2, "y", "retry_coverage")]
    return drafts.accepted_outline(table(t, "doc_id int, attempt int, outline string, verdict string", rows)).drop("outline")


@expect("task_id INT, text VARCHAR", [(1, "- T1 | S1 | a；b；c | C1\n- S2"), (2, "- " + "x" * 1598 + "…")])
def short_digest_cases(t: Tables) -> DataFrame:
    rows = [(1, 0, "T1", "S1", ["a", " b", "c", "d"], "C1"), (1, 1, None, "S2", None, ""), (1, 2, "", None, [], None), (2, 0, "x" * 1700, None, None, None), (2, 1, "later", None, None, None)]
    return drafts.short_digest(table(t, "task_id int, order_index int, title string, summary string, key_points array<string>, conclusion string", rows))


@expect("task_id INT, text VARCHAR", [(1, "[T] S 要点: a; b\n" + "s" * 200), (2, "（无源材料）"), (3, "[" + "y" * 1990 + "] \n[z] qqq")])
def judge_summary_cases(t: Tables) -> DataFrame:
    rows = [(1, 0, "T", "S", ["a", "b"]), (1, 1, None, "s" * 300, None), (2, 0, None, None, None), (3, 0, "y" * 1990, None, None), (3, 1, "z", "qqqqqqqqqq", None)]
    return drafts.judge_summary(table(t, "task_id int, order_index int, title string, summary string, key_points array<string>", rows))


@expect("task_id INT, text VARCHAR", [(1, "【W1】 A\n   摘要: s\n   链接: u\n【W2】 B\n   摘要: \n   链接: ")])
def web_citation_cases(t: Tables) -> DataFrame:
    rows = [(1, 0, "A", "u", "s"), (1, 1, " ", "v", "w"), (1, 2, "B", None, None), *[(1, k, "late", "u", "s") for k in range(8, 10)], *[(1, k, "", "u", "s") for k in range(3, 8)]]
    return drafts.web_citations(table(t, "task_id int, pos int, title string, url string, snippet string", rows))


@expect("id INT, x VARCHAR", [(0, "前文。要点一；要点二；要点三。"), (1, "本节围绕相关材料进行归纳整理，并给出可执行的观点与结论。"), (2, "只有前文。")])
def fallback_section_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, a string, b string", [(0, "前文。", "- 要点一\n- 要点二\n\n- 要点三\n- 要点四"), (1, None, ""), (2, "只有前文", None)])
    return rows.select("id", drafts.fallback_section(F.col("a"), F.col("b")).alias("x"))


@expect("id INT, x VARCHAR", [(0, "市场规模|主要厂商"), (1, "技术路线图"), (2, "")])
def knowledge_point_cases(t: Tables) -> DataFrame:
    context = "[章节素材: 市场概况]\n来源: a\n知识点: 市场规模; 主要厂商；短\n[章节素材: 技术发展趋势]\n知识点: 技术路线图\n"
    rows = table(t, "id int, c string, title string", [(0, context, "市场概况"), (1, context, "技术发展与展望"), (2, context, "完全无关")])
    return rows.select("id", F.array_join(drafts.knowledge_points(F.col("c"), F.col("title")), "|").alias("x"))


@expect("id INT, title VARCHAR, points VARCHAR", [(1, "市场概况分析", "第一个知识点|第二个知识点"), (1, "技术", "第三个知识点")])
def checklist_cases(t: Tables) -> DataFrame:
    answers = table(t, "id int, answer string", [(1, "前言\n## 市场概况\n- 第一个知识点\n- 短\n- 第二个知识点\n## 技术路线\n- 第三个知识点")])
    titles = table(t, "id int, pos int, title string", [(1, 0, "市场概况分析"), (1, 1, "技术"), (1, 2, "别的内容")])
    return drafts.checklists(answers, titles).select("id", "title", F.array_join("points", "|").alias("points"))


@expect("id INT, needed BOOLEAN, accepted VARCHAR, layers INT, missing VARCHAR", [(0, False, "0123456789", 2, ""), (1, False, "0123456789", 3, "成本|风险分析"), (2, True, "修正后的文本", 4, "")])
def critic_gate_cases(t: Tables) -> DataFrame:
    """No correction for three low issues; a correction of under half the length is refused; 3000 and 8000 characters add layers."""
    rows = table(t, "id int, fixable int, low int, content string, fixed string, n int, answer string", [(0, 0, 0, "0123456789", "01234", 2999, "OK"), (1, 3, 3, "0123456789", None, 3000, "- 成本\n2. 风险分析\nx"), (2, 4, 4, "0123456789", "修正后的文本", 8000, "无")])
    return rows.select("id", drafts.fix_needed(F.col("fixable"), F.col("low")).alias("needed"), drafts.accept_fix(F.col("content"), F.col("fixed")).alias("accepted"), drafts.review_layers(F.expr("repeat('x', n)")).alias("layers"), F.array_join(drafts.missing_topics(F.col("answer")), "|").alias("missing"))


@expect("id INT, x VARCHAR", [(0, ""), (1, "first"), (2, "retry"), (3, "rule")])
def critic_answer_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, n int, a string, b string", [(0, 99, "first", "retry"), (1, 100, "first", "retry"), (2, 100, " ", "retry"), (3, 100, None, "")])
    return rows.select("id", drafts.critic_answer(F.expr("repeat('x', n)"), F.col("a"), F.col("b"), F.lit("rule")).alias("x"))


@expect("doc_id INT, order_index INT, has_transition BOOLEAN", [(1, 0, False), (1, 1, True), (1, 2, False)])
def transition_cases(t: Tables) -> DataFrame:
    rows = [(1, 0, "第一句。接下来讨论方法。"), (1, 1, "接下来开头。第二句。第三句。第四句。"), (1, 2, "末节")]
    return review.transitions(table(t, "doc_id int, order_index int, body string", rows))


@expect("id INT, line VARCHAR", [(0, "（第 3 页表格，2 行 2 列，表头：年份/收入，标题：表1 收入）"), (1, "（第 1 页表格，0 行 0 列）")])
def table_summary_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, page int, r array<array<string>>, h array<string>, c string", [(0, 3, [["2023", "1"], ["2024", "2"]], ["年份", "收入"], "表1 收入"), (1, 1, [], [], None)])
    return rows.select("id", drafts.table_summary(F.col("page"), F.col("r"), F.col("h"), F.col("c")).alias("line"))


@expect("page INT, table_id INT, caption VARCHAR", [(1, 1, "表1 近的标题"), (1, 2, "下方说明"), (2, 1, "")])
def caption_cases(t: Tables) -> DataFrame:
    tables = table(t, "page int, table_id int, top double, bottom double", [(1, 1, 200.0, 300.0), (1, 2, 600.0, 700.0), (2, 1, 100.0, 200.0)])
    lines = table(t, "page int, y double, line string", [(1, 120.0, "远的标题"), (1, 190.0, "表1 近的标题"), (1, 195.0, "ab"), (1, 710.0, "下方说明"), (2, 400.0, "太远的行")])
    return drafts.captions(tables, lines).select("page", "table_id", "caption")


@expect("id INT, best VARCHAR, text VARCHAR, wants_aux BOOLEAN", [(0, "Name: Ada\nDate: May", "Name: Ada\nDate: May\nextra", True)])
def ocr_variant_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, a string, b string, c string", [(0, "name: ada", "Name: Ada\nDate: May", "extra")])
    return rows.select("id", drafts.ocr_variants(F.col("a"), F.col("b"), F.col("c")).alias("x")).select("id", "x.best", "x.text", "x.wants_aux")


@expect("doc_id INT, title VARCHAR, place INT", [(1, "b", 1), (1, "a", 2)])
def weakest_section_cases(t: Tables) -> DataFrame:
    sections = table(t, "doc_id int, title string, body string", [(1, "a", "x" * 50), (1, "b", "x" * 80), (1, "c", "short")])
    scores = table(t, "doc_id int, title string, faithfulness double", [(1, "a", 0.9), (1, "b", 0.2), (1, "c", 0.0)])
    return drafts.weakest_sections(sections, scores).select("doc_id", "title", "place")


@expect("system VARCHAR, clean_cases BIGINT, corrupt_cases BIGINT, clean_pass_rate DOUBLE, corrupt_detect_rate DOUBLE, balanced_score DOUBLE, issues_clean DOUBLE, issues_corrupt DOUBLE, invalid_rate DOUBLE", [("planner", 2, 1, 0.5, 1.0, 0.75, 1.0, 3.0, 0.3333)])
def critic_summary_cases(t: Tables) -> DataFrame:
    rows = [("planner", "clean", True, 0, False), ("planner", "clean", False, 2, True), ("planner", "corrupt", False, 3, False)]
    return drafts.critic_summary(table(t, "system string, variant string, passed boolean, issue_count int, invalid boolean", rows))


@expect("id INT, points INT, covered INT, coverage DOUBLE", [(1, 2, 1, 0.5)])
def answer_coverage_cases(t: Tables) -> DataFrame:
    return drafts.answer_coverage(table(t, "id int, content string, gold array<array<string>>", [(1, "It opened in  New-York, 1931.", [["new york", "NYC"], ["x", "1932"]])]))


@expect("id INT, x VARCHAR", [(0, "Bob wrote it. Ann agreed."), (1, "Nothing here. It was officially revised in 2019 according to later reports.")])
def corrupted_answer_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, a string, gold array<array<string>>, decoys array<string>", [(0, "Ann wrote it. Ann agreed.", [["Ann"]], ["ann", "Bob"]), (1, "Nothing here. ", [["Eve"]], ["Bob"])])
    return rows.select("id", drafts.corrupted_answer(F.col("a"), F.col("gold"), F.col("decoys")).alias("x"))


# retrieval


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")])
def ordered_union_cases(t: Tables) -> DataFrame:
    rows = [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "b"), (1, 1, 1, "c"), (1, 2, 0, "d")]
    return answering.ordered_union(table(t, "query_id int, list int, pos int, chunk_id string", rows), 3)


@expect("id INT, text VARCHAR", [(1, "## [1] 成本分析\n成本很高\n\n## [2] 背景\n提到成本")])
def snippet_cases(t: Tables) -> DataFrame:
    return answering.pick_snippets(table(t, "id int, query string, text string", [(1, "成本", "前言\n## 背景\n提到成本\n## 无关\n别的\n## 成本分析\n成本很高")]))


@expect("query_id INT, ok BOOLEAN", [(1, True), (3, True), (4, False)])
def quality_cases(t: Tables) -> DataFrame:
    rows = [(1, f"d{k}", s) for k, s in enumerate([0.9, 0.8, 0.75])] + [(3, f"d{k}", s) for k, s in enumerate([0.95, 0.1, 0.1, 0.1, 0.1])] + [(4, "d", 0.2), (4, "d", 0.15)]
    hits = table(t, "query_id int, doc_id string, score double", rows)
    loose, strict = search.quality_ok(hits.where("query_id < 4")), search.quality_ok(hits.where("query_id = 4"), 0.5, 1, 2)
    return loose.union(strict)


@expect("id INT, year VARCHAR", [(0, "2024"), (1, "2023"), (2, "2022"), (3, "")])
def year_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, m string, d string, c string", [(0, "2024", "paper_2023.pdf", "发表于2022年"), (1, None, "paper_2023.pdf", "发表于2022年"), (2, "", "paper.pdf", "发表于2022年"), (3, None, None, "无")])
    return rows.select("id", X.text_year(F.col("m"), F.col("d"), F.col("c")).alias("year"))


@expect("query_id INT, recall DOUBLE, precision DOUBLE, mrr DOUBLE, ndcg DOUBLE", [(1, 0.5, 0.5, 1.0, 1.0), (2, 0.0, 0.0, 0.25, 0.0), (3, 0.0, 0.0, 0.0, 0.0)])
def duplicate_gain_cases(t: Tables) -> DataFrame:
    """A relevant document found twice gains twice against an ideal of two; a first relevant rank beyond k still counts for mrr."""
    found = table(t, "query_id int, rank int, doc_id string", [(1, 1, "a"), (1, 2, "a"), (1, 3, "x"), (2, 1, "x"), (2, 2, "y"), (2, 3, "z"), (2, 4, "a")])
    rel = table(t, "query_id int, doc_id string", [(1, "a"), (1, "b"), (2, "a"), (3, "a")])
    return review.retrieval_metrics(found, rel, 3)


@expect("id INT, score DOUBLE", [(0, 0.5), (1, 1.0), (2, 0.5), (3, 0.0)])
def pair_relevance_cases(t: Tables) -> DataFrame:
    """Pairs of a prompt in a text: none needed, all at the front, one of three behind and in front (.5), none."""
    rows = table(t, "id int, c string, p string", [(0, "", "人工"), (1, "人工智能报告", "人工智能"), (2, "人工计算", "人工智能"), (3, "完全无关", "人工智能")])
    return rows.select("id", relevance.pair_relevance(F.col("c"), F.col("p")).alias("score"))


@expect("doc_id INT, sections BIGINT, similarity DOUBLE, coherence DOUBLE", [(1, 1, None, 1.0), (2, 2, 1.0, 0.0), (3, 2, 0.0, 0.0)])
def coherence_cases(t: Tables) -> DataFrame:
    """A single section is coherent; repeated and unrelated ones aren't."""
    rows = [(1, 0, "alpha beta"), (2, 0, "alpha beta"), (2, 1, "beta alpha"), (3, 0, "alpha beta"), (3, 1, "gamma delta")]
    return relevance.section_coherence(table(t, "doc_id int, order_index int, body string", rows))


@expect("id INT, plain DOUBLE, boosted DOUBLE", [(0, 1.3, 1.3), (1, 1.3, 1.75), (2, 0.5, 0.625)])
def overlap_score_cases(t: Tables) -> DataFrame:
    """All tokens and the phrase in the text; the phrase in the title too; half of the tokens, also in the title."""
    rows = table(t, "id int, q string, title string, c string", [(0, "solar power", "x", "about solar  power"), (1, "solar power", "Solar Power", "solar power"), (2, "solar power", "solar", "wind")])
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), 0)
    return rows.select("id", *[relevance.overlap_score(F.col("q"), F.col("title"), F.col("c"), toks, b).alias(n) for n, b in (("plain", False), ("boosted", True))])


@expect("id INT, tokens VARCHAR, relevant BOOLEAN", [(0, "AG|RA|技术", True), (1, "2024", False)])
def script_token_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, q string, c string", [(0, "RAG技术", "RAG 方法"), (1, "2024", "二〇二四")])
    return rows.select("id", F.array_join(F.array_sort(relevance.script_tokens(F.col("q"))), "|").alias("tokens"), relevance.keyword_relevant(F.col("q"), F.col("c")).alias("relevant"))


@expect("query_id INT, recall3 DOUBLE, recall5 DOUBLE, mrr DOUBLE", [(1, 1.0, 1.0, 1.0)])
def tfidf_retrieval_cases(t: Tables) -> DataFrame:
    chunks = table(t, "kb string, chunk_id string, content string", [("k", "a", "solar panels on roofs"), ("k", "b", "wind mills at sea"), ("k", "c", "solar power plants")])
    queries = table(t, "query_id int, kb string, query string", [(1, "k", "solar"), (2, "k", "zzz")])
    return relevance.tfidf_retrieval(chunks, queries)


# records, versions, tasks


@expect("task_id INT, order_index INT, title VARCHAR, points VARCHAR, files VARCHAR", [(1, 0, "年度报告", "收入|利润|成本", "a.pdf|b.pdf"), (1, 2, "其他主题", "", "c.pdf"), (2, 0, "年度报告", "收入", "d.pdf")])
def merge_record_cases(t: Tables) -> DataFrame:
    """Two files of one task resemble each other and become one record; a third one and another task's stay."""
    rows = [
        (1, 0, "a.pdf", "年度报告", "公司年度收入与利润情况说明", ["收入", "利润"], None), (1, 1, "b.pdf", "年度报告", "公司年度收入与利润情况说明。", ["利润", "成本"], None),
        (1, 2, "c.pdf", "其他主题", "关于员工培训的通知", [], None), (2, 0, "d.pdf", "年度报告", "公司年度收入与利润情况说明", ["收入"], None),
    ]
    found = records.merge_similar(table(t, "task_id int, order_index int, file string, title string, summary string, key_points array<string>, data string", rows), least=0.75)
    return found.select("task_id", "order_index", "title", F.array_join("key_points", "|").alias("points"), F.array_join("files", "|").alias("files"))


@expect("doc_id INT, kind VARCHAR, version INT, selected BOOLEAN", [(1, "content", 1, False), (1, "content", 2, True), (1, "outline", 1, True), (2, "content", 1, True)])
def select_version_cases(t: Tables) -> DataFrame:
    """One version of a kind is selected at a time; a choice that doesn't exist changes nothing."""
    versions = table(t, "doc_id int, kind string, version int, selected boolean", [(1, "content", 1, True), (1, "content", 2, False), (1, "outline", 1, True), (2, "content", 1, True)])
    return records.select_version(versions, table(t, "doc_id int, kind string, version int", [(1, "content", 2), (2, "content", 9)]))


@expect("task_id VARCHAR, status VARCHAR, has_chat BOOLEAN", [("t2", "done", True), ("t1", "running", False)])
def task_list_cases(t: Tables) -> DataFrame:
    status = table(t, "task_id string, status string, stage string, message string, updated_at long", [("t1", "queued", "", "", 1), ("t1", "running", "", "", 2), ("t2", "done", "", "", 3), ("kb", "done", "", "", 9), (".x", "done", "", "", 9)])
    return records.list_tasks(status, table(t, "task_id string", [("t2",), ("t2",)])).select("task_id", "status", "has_chat")


@expect("kb VARCHAR, docs BIGINT, chunks BIGINT", [("a", 2, 3)])
def base_stats_cases(t: Tables) -> DataFrame:
    return records.base_stats(table(t, "kb string, doc_id string", [("a", "x"), ("a", "x"), ("a", "y"), ("a", "__registry__a"), ("b", "__registry__b")]))


@expect("id INT, b_wins BOOLEAN", [(0, True), (1, False), (2, True), (3, True)])
def better_quality_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, a struct<filled:int,ratio:double>, b struct<filled:int,ratio:double>", [(0, (3, 0.9), (4, 0.1)), (1, (3, 0.9), (3, 0.8)), (2, (3, 0.9), (3, 0.9)), (3, None, (0, 0.0))])
    return rows.select("id", records.better_quality(F.col("a"), F.col("b")).alias("b_wins"))


# chunks


@expect("doc_id BIGINT, chunk_index INT, section_path VARCHAR, content VARCHAR", [
    (1, 0, "Manual / A", "Manual / A\nfirst line\nsecond line"), (1, 1, "Manual / A / B", "Manual / A / B\n| x | y |\n| - | - |\n| 1 | 2 |\nafter the table"), (2, 0, "Manual", "Manual\nno heading here"), (3, 0, "项目背景", "项目背景\n这是一段正文，说明了项目的由来。"),
])
def chunk_path_cases(t: Tables) -> DataFrame:
    """The title heads each path and is not said twice; a plain text has title-like lines for headings."""
    rows = [(1, "# Manual\n## A\nfirst   line\nsecond line\n### B\n| x | y |\n| - | - |\n| 1 | 2 |\n\nafter the table", "Manual", True), (2, "no heading here", "Manual", True), (3, "项目背景\n这是一段正文，说明了项目的由来。", "", False)]
    made = chunking.chunk_documents(table(t, "doc_id long, text string, title string, markdown boolean", rows))
    return made.select("doc_id", F.col("chunk_index").cast("int"), "section_path", "content")


@expect("doc_id BIGINT, chunk_index INT, n INT", [(1, 0, 188), (1, 1, 251)])
def chunk_size_cases(t: Tables) -> DataFrame:
    """18 sentences of 20 characters part in nines (188 with line ends); the second nine stand behind the 62 characters from the line end next to the 60th last."""
    rows = [(1, "。".join("一二三四五六七八九十一二三四五六七八九"[:19] for _ in range(18)) + "。")]
    made = chunking.chunk_documents(table(t, "doc_id long, text string", rows), 200, 60)
    return made.select("doc_id", F.col("chunk_index").cast("int"), F.length("content").alias("n"))


@expect("doc_id BIGINT, chunk_index INT, content VARCHAR", [(1, 0, "first part"), (1, 1, "second"), (1, 2, "part"), (2, 0, "xxxxxxxxxx"), (2, 1, "xx")])
def plain_recursive_cases(t: Tables) -> DataFrame:
    return chunking.recursive_chunks(table(t, "doc_id long, text string", [(1, "first part\n\nsecond      part"), (2, "x" * 12), (3, None)]), 10)


@expect("doc_id BIGINT, rate DOUBLE", [(1, 0.5), (2, 0.0)])
def kept_header_cases(t: Tables) -> DataFrame:
    """Of two neighbouring pairs one crosses from the first section to the second."""
    docs = table(t, "doc_id long, text string", [(1, "# A\none two\nthree four\n# B\nfive"), (2, "plain")])
    chunks = table(t, "doc_id long, chunk_index int, content string", [(1, 0, "# A one two"), (1, 1, "three four"), (1, 2, "# B five"), (2, 0, "plain")])
    return chunking.kept_headers(chunks, docs)


@expect("doc_id INT, n INT, kind VARCHAR, field VARCHAR, value VARCHAR", [(1, 1, "slots", "To", "Ann"), (1, 2, "lines", "From", "Bob")])
def pair_fusion_cases(t: Tables) -> DataFrame:
    rows = [(1, "lines", 0, "TO", "ann"), (1, "lines", 1, "From", "Bob"), (1, "slots", 0, "To", "Ann")]
    return layout.merge_pairs(table(t, "doc_id int, kind string, pos int, field string, value string", rows), {"slots": 4, "lines": 4})


# what whole tables leave untested


@expect("kb INT, missing BIGINT", [(1, 2)])
def empty_embedding_cases(t: Tables) -> DataFrame:
    rows = table(t, "label int, embedding array<float>", [(1, None), (1, []), (1, [1.0]), (2, [0.5])])
    return rows.where("embedding IS NULL OR size(embedding) = 0").groupBy(F.col("label").alias("kb")).agg(F.count("*").alias("missing"))


@expect("doc_a INT, doc_b INT, common BIGINT", [(1, 2, 3)])
def overlap_cases(t: Tables) -> DataFrame:
    rows = [(1, x) for x in "abcd"] + [(2, x) for x in "bcd"] + [(3, x) for x in "cd"]
    return facts.shared_terms(table(t, "doc_id int, term string", rows))


@expect("t INT, key VARCHAR, heading VARCHAR, score DOUBLE", [(1, "市场分析", "市场分析与展望", round(8 / 11 + 0.3, 6)), (1, "abcd", "abce", 0.75), (1, "完全无关", None, None)])
def heading_cases(t: Tables) -> DataFrame:
    """Four of 4 and 7 characters match, .3 more as the heading holds the key; three of four; nothing near."""
    keys = table(t, "t int, key string", [(1, "市场分析"), (1, "abcd"), (1, "完全无关")])
    heads = table(t, "t int, pos int, heading string", [(1, 0, "市场分析与展望"), (1, 1, "abce"), (2, 2, "完全无关")])
    return matching.best_headings(keys, heads, ["t"]).select("t", "key", "heading", "score")


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "b"), (1, 2, "c"), (1, 3, "e"), (1, 4, "d")])
def near_duplicate_hit_cases(t: Tables) -> DataFrame:
    """By score: a is what b says, and goes; hits without any fingerprint stay."""
    rows = [(1, 1, "a", 0.5, "the quick brown fox jumps over it"), (1, 2, "b", 0.9, "The quick brown fox jumps over it!"), (1, 3, "c", 0.8, "something else entirely"), (1, 4, "d", 0.1, ""), (1, 5, "e", 0.2, "?")]
    return search.drop_similar(table(t, "query_id int, rank int, chunk_id string, score double, content string", rows))


@expect("key INT, kept_key INT", [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)])
def record_dedup_cases(t: Tables) -> DataFrame:
    """Texts equal but for case and punctuation, one with a word more, and one of its own."""
    base = "the annual report on revenue and profit of the whole company group in detail"
    rows = [(1, base), (2, base.upper() + "!"), (3, "minutes of the board meeting held in spring about the new plant"), (4, "minutes of the board meeting held in spring about the new plants"), (5, "unrelated")]
    return records.near_duplicates(table(t, "id int, text string", rows), "text", "id")


@expect("doc_id INT, section BIGINT, level INT, section_path VARCHAR, body VARCHAR", [(1, 0, 0, "", "intro"), (1, 1, 1, "A", "text a"), (1, 2, 2, "A / B", "```\n# no heading\n```"), (1, 3, 3, "A / B / C", ""), (1, 4, 2, "A / D", "text d")])
def section_path_cases(t: Tables) -> DataFrame:
    text = "intro\n# A\ntext a\n## B\n```\n# no heading\n```\n### C\n## D\ntext d"
    return chunking.markdown_sections(table(t, "doc_id int, text string", [(1, text)]))


@expect("id INT, vec INT, lex INT, w_vec DOUBLE, w_bm25 DOUBLE", [(0, 80, 144, 0.95, 1.1), (1, 144, 64, 1.1, 0.95), (2, 120, 96, 1.0, 1.0)])
def adaptive_cases(t: Tables) -> DataFrame:
    """Candidates and weights for 8 hits: a figure wants words, an abstract question meaning, others neither."""
    rows = table(t, "id int, q string", [(0, "2024"), (1, "为什么"), (2, "天气")])
    vec, lex = answering.budgets(F.col("q"), 8)
    w = answering.weights(F.col("q"))
    return rows.select("id", vec.alias("vec"), lex.alias("lex"), w["vec"].alias("w_vec"), w["bm25"].alias("w_bm25"))


def _small(t: Tables) -> tuple[DataFrame, DataFrame]:
    chunks = table(t, "kb string, doc_id int, chunk_id string, chunk_index int, section_path string, content string, embedding array<double>, updated_at timestamp", [
        ("k", 1, "a", 0, "", "solar power on roofs. It is cheap. Wind is not.", [1.0, 0.0], None), ("k", 1, "b", 1, "", "wind mills at sea", [0.0, 1.0], None), ("k", 2, "c", 0, "", "solar power plants", [1.0, 0.2], None),
    ])
    return chunks, table(t, "query_id int, query string, embedding array<double>", [(1, "solar power", [1.0, 0.0])])


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "a"), (1, 2, "b"), (1, 3, "c")])
def small_search_cases(t: Tables) -> DataFrame:
    """a leads in vector and words. Its document's chunks add up to more than c alone, so b stands behind a."""
    return search.search(*_small(t), 8).select("query_id", "rank", "chunk_id")


@expect("query_id INT, rank INT, chunk_id VARCHAR, score DOUBLE", [(1, 1, "a", round(1 / 61 + 1 / 62, 9)), (1, 2, "c", round(1 / 61 + 1 / 62, 9))])
def multi_query_cases(t: Tables) -> DataFrame:
    """Both wordings find both chunks: each adds 1 / (60 + its number)."""
    chunks, _ = _small(t)
    variants = table(t, "query_id int, variant int, question string, query string, embedding array<double>", [(1, 1, "天气", "solar power", [1.0, 0.0]), (1, 2, "天气", "solar plants", [1.0, 0.1])])
    return answering.search_multi_query(chunks.where("chunk_id <> 'b'"), variants, 2).select("query_id", "rank", "chunk_id", "score")


@expect("query_id INT, rank INT, chunk_id VARCHAR, score DOUBLE", [(1, 1, "a", round(1.2 / 61 + 1 / 62, 9)), (1, 2, "c", round(1.2 / 62 + 1 / 61, 9))])
def stepback_cases(t: Tables) -> DataFrame:
    """a leads for the question, c for the broader one."""
    chunks, _ = _small(t)
    own = table(t, "query_id int, query string, embedding array<double>", [(1, "roofs", [1.0, 0.0])])
    back = table(t, "query_id int, query string, embedding array<double>", [(1, "plants", [1.0, 0.2])])
    return answering.search_stepback(chunks.where("chunk_id <> 'b'"), own, back, 2).select("query_id", "rank", "chunk_id", "score")


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "a"), (1, 2, "x")])
def several_base_cases(t: Tables) -> DataFrame:
    """Document 1 of the second base was found in the first one already."""
    one = lambda c, q, k: c.select(F.lit(1).alias("query_id"), F.col("place").alias("rank"), "chunk_id", "doc_id", "score")
    a = table(t, "place int, chunk_id string, doc_id int, score double", [(1, "a", 1, 0.9)])
    b = table(t, "place int, chunk_id string, doc_id int, score double", [(1, "y", 1, 0.95), (2, "x", 2, 0.5)])
    return answering.search_in_bases([("a", a), ("b", b)], table(t, "query_id int", [(1,)]), 5, one).select("query_id", "rank", "chunk_id")


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
def routed_cases(t: Tables) -> DataFrame:
    """A comparison asks for several wordings only, a plain fact for its rewording."""
    queries = table(t, "query_id int, query string", [(1, "两个方案的区别在哪"), (2, "2024年研发投入占比")])
    hits = lambda rows: table(t, "query_id int, chunk_id string, score double", rows)
    found = answering.routed(queries, {"multi_query": hits([(1, "a", 0.9), (1, "b", 0.4), (2, "z", 0.9)]), "rewritten": hits([(1, "z", 0.99), (2, "c", 0.3)])})
    return found.select("query_id", "rank", "chunk_id")


@expect("query_id INT, degraded BOOLEAN", [(1, False), (2, True)])
def low_score_cases(t: Tables) -> DataFrame:
    return answering.low_scores(table(t, "query_id int, score double", [(1, 0.01), (1, 0.06), (2, 0.05)]))


@expect("chunk_id VARCHAR, n INT, first DOUBLE", [("a", 1, 1.0), ("b", 2, 9.0), ("c", 2, 9.0)])
def reembed_cases(t: Tables) -> DataFrame:
    """Only chunks without a vector get a new one."""
    rows = table(t, "chunk_id string, embedding array<double>", [("a", [1.0]), ("b", []), ("c", None)])
    made = answering.reembed(rows, lambda c: c.withColumn("embedding", F.array(F.lit(9.0), F.lit(9.0))))
    return made.select("chunk_id", F.size("embedding").alias("n"), F.col("embedding")[0].alias("first"))


@expect("label VARCHAR, value DOUBLE", [("a", 3.0), ("b", 5.0)])
def chart_cases(t: Tables) -> DataFrame:
    return drafts.chart(table(t, "x string, y int", [("a", 1), ("a", 2), ("b", 5)]), "bar", "x", "y")


@expect("id INT, a VARCHAR", [(0, "body\n\n[表格]\nt\n\n[OCR]\no"), (1, "[OCR]\no")])
def compose_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, b string, tab string, o string", [(0, "body", "t", "o"), (1, " ", None, "o")])
    return rows.select("id", drafts.compose_record(F.col("b"), F.col("tab"), F.col("o")).alias("a"))


@expect("page INT, item VARCHAR, row BIGINT, col BIGINT", [(1, "A", 0, 0), (1, "B", 0, 1), (1, "C", 0, 2), (1, "head", 0, 1), (1, "x", 1, 0), (1, "y", 1, 1), (1, "z", 1, 2)])
def grid_cases(t: Tables) -> DataFrame:
    """Two rows of three with jitter; a single heading right above the first one joins it."""
    rows = [(1, n, 1.0, x, y, x + 20.0, y + 10.0) for n, x, y in [("head", 100.0, 88.0), ("A", 10.0, 100.0), ("B", 100.0, 101.5), ("C", 190.0, 99.0), ("x", 11.0, 140.0), ("y", 101.0, 141.5), ("z", 189.0, 139.0)]]
    placed = layout.columns(layout.cluster_rows(table(t, "page int, text string, score double, left double, top double, right double, bottom double", rows)))
    return placed.select("page", F.col("text").alias("item"), "row", "col")


@expect("id INT, headers VARCHAR, rows VARCHAR, ragged BOOLEAN, empty_header BOOLEAN, truncated BOOLEAN", [(0, "Year,Sum,", "2023,10 20,x", True, False, False), (1, "a,b", "", False, False, False), (2, "", "", False, False, False), (3, "", "", False, False, False)])
def clean_table_cases(t: Tables) -> DataFrame:
    """Rows without content go, so a header can't be empty then; shorter rows are padded."""
    rows = table(t, "id int, r array<array<string>>", [(0, [["Year", "Sum"], ["", None], ["2023", "10\n 20", "x"]]), (1, [["a", " b "]]), (2, [[" ", ""]]), (3, [])])
    made = rows.select("id", layout.clean_table(F.col("r")).alias("x"))
    return made.select("id", F.array_join("x.headers", ",").alias("headers"), F.array_join(F.transform("x.rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), "x.ragged", "x.empty_header", "x.truncated")


@expect("doc_id INT, n INT, field VARCHAR, value VARCHAR", [(1, 1, "Special notes", "first line second line"), (1, 2, "BRAND", "Acme"), (1, 3, "Delivery date", "Monday")])
def section_pair_cases(t: Tables) -> DataFrame:
    return layout.section_pairs(table(t, "doc_id int, text string", [(1, "header\nSpecial notes:\nfirst  line\nsecond line\nBRAND\nAcme\nDelivery date:\nMonday\nSPECIAL NOTES:\nFirst line\nsecond line")]))


@expect("doc_id INT, n INT, field VARCHAR, value VARCHAR", [(1, 1, "To:", "Ann"), (1, 2, "Date:", "May 5"), (1, 3, "FAX NUMBER", "555")])
def reading_order_cases(t: Tables) -> DataFrame:
    return layout.reading_order_pairs(table(t, "doc_id int, text string", [(1, "To: Ann\nDate:\nMay 5\nFAX NUMBER\n555\nto: ann")]))


@expect("doc_id INT, n INT, kind VARCHAR, what VARCHAR", [(1, 1, "figure", "1999"), (1, 2, "entity", "Marie Curie")])
def heuristic_critic_cases(t: Tables) -> DataFrame:
    return review.heuristic_critic(table(t, "doc_id int, body string, materials string", [(1, "It sold 30 units in 1999. The lab of Marie Curie grew. The end.", "sold 30 units by a lab")]))


@expect("id INT, n INT, type VARCHAR, location VARCHAR, description VARCHAR, severity VARCHAR", [(1, 0, "事实", "第一段", "数字不符", "高"), (1, 1, "结构", "第二段", "缺少过渡", "中")])
def critic_line_cases(t: Tables) -> DataFrame:
    return review.critic_lines(table(t, "id int, answer string", [(1, "## 问题 1 | 事实 | 第一段 | 数字不符 | 高\n## 问题 2 | 结构 | 第二段 | 缺少过渡\n## 标题\n@@SEARCH: a")]))


@expect("id INT, queries VARCHAR", [(0, "市场规模|增长率"), (1, "")])
def wanted_search_cases(t: Tables) -> DataFrame:
    return each(t, ["OK\n@@search: 市场规模, 增长率,", "没有"], lambda c: F.array_join(review.wanted_searches(c), "|"), "queries")


@expect("id INT, relevance DOUBLE, faithfulness DOUBLE, coherence DOUBLE", [(0, 0.8, 1.0, 0.0), (1, 0.6, 0.0, 0.4), (2, 0.0, 0.0, 0.0)])
def judge_score_cases(t: Tables) -> DataFrame:
    texts = ['```json\n{"scores": {"relevance": {"score": 4}, "faithfulness": {"score": 5}}}\n```', '{"relevance": 3, "coherence": {"score": 2}}', "no json"]
    return each(t, texts, review.judge_scores).select("id", "x.relevance", "x.faithfulness", "x.coherence")


@expect("doc_id INT, total INT, valid INT, accuracy DOUBLE", [(1, 2, 1, 0.5), (2, 0, 0, 1.0)])
def citation_accuracy_cases(t: Tables) -> DataFrame:
    return review.citation_accuracy(table(t, "doc_id int, body string, sources string", [(1, "增长（据Annual Report）下降(据未知来源)", "the annual report of 2024"), (2, "无引用", "x")]))


@expect("doc_id INT, issues VARCHAR", [(1, "数字:92.1%,机构:新星医院,年份:2019"), (2, "")])
def cross_check_cases(t: Tables) -> DataFrame:
    """The company's name differs behind its first four characters only."""
    rows = [(1, "准确率95.3%，另称92.1%；华东电力公司，新星医院，2019", "准确率95.3%，华东电力集团，2020-2021"), (2, "全是新的99%", "")]
    return facts.cross_check(table(t, "doc_id int, body string, materials string", rows)).select("doc_id", F.array_join("issues", ",").alias("issues"))


@expect("doc_id INT, order_index INT, body VARCHAR", [(1, 0, "a"), (1, 1, "B"), (1, 2, "c"), (1, 3, "d")])
def regenerate_cases(t: Tables) -> DataFrame:
    """Section 1 and what stands under it are written anew; an empty text keeps the old one, and section 3 is outside."""
    sections = table(t, "doc_id int, order_index int, level int, title string, body string", [(1, 0, 1, "A", "a"), (1, 1, 2, "B", "b"), (1, 2, 3, "C", "c"), (1, 3, 2, "D", "d")])
    new = table(t, "doc_id int, order_index int, body string", [(1, 1, "B"), (1, 2, " "), (1, 3, "X")])
    return review.regenerate(sections, table(t, "doc_id int, order_index int", [(1, 1)]), new).select("doc_id", "order_index", "body")


@expect("task_id VARCHAR, title VARCHAR, created DOUBLE, updated DOUBLE", [("a", "old", 1.0, 9.0), ("b", "new", 9.0, 9.0), ("c", "kept", 2.0, 2.0)])
def create_task_cases(t: Tables) -> DataFrame:
    tasks = table(t, "task_id string, title string, created_at double, updated_at double", [("a", "old", 1.0, 1.0), ("c", "kept", 2.0, 2.0)])
    made = records.create_tasks(tasks, table(t, "task_id string, title string", [("a", "x"), ("b", "new")]), 9.0)
    return made.select("task_id", "title", F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))


@expect("id INT, n INT", [(0, 2), (1, 0), (2, 0)])
def float_list_cases(t: Tables) -> DataFrame:
    return each(t, [["1", "2.5"], ["1", "x"], None], lambda c: F.size(M.float_list(c)), "n", "array<string>")


@expect("doc_id INT, chars INT, marks INT", [(1, 21001, 0), (2, 9 * 1001 + sum(len(f"[Page {k}] ") for k in range(1, 10)) - 1, 9)])
def page_range_cases(t: Tables) -> DataFrame:
    """Three long pages stop once 20000 characters are passed; nine pages make two ranges, each with room for all of its pages."""
    from textloom.sources import files

    pages = [(1, k, "x" * n) for k, n in ((1, 15000), (2, 6000), (3, 10))] + [(2, k, "y" * 1000) for k in range(1, 10)]
    made = files.page_ranges(table(t, "doc_id int, page int, text string", pages))
    return made.select("doc_id", F.length("text").alias("chars"), F.regexp_count("text", F.lit(r"\[Page ")).alias("marks"))


@expect("task_id VARCHAR, state VARCHAR", [("a", "paused"), ("b", "running"), ("c", "cancelled")])
def control_cases(t: Tables) -> DataFrame:
    from textloom.streaming import events

    rows = [("a", 1, "pause"), ("b", 1, "pause"), ("b", 2, "resume"), ("c", 1, "cancel"), ("c", 2, "resume"), ("c", 3, "section")]
    made = table(t, "task_id string, seq long, kind string", rows).withColumn("updated_at", F.timestamp_seconds(F.col("seq")))
    return events.control_state(made)


@expect("task_id VARCHAR, section VARCHAR, text VARCHAR", [("a", "s", "one two")])
def token_stream_cases(t: Tables) -> DataFrame:
    from textloom.streaming import events

    return events.assembled(table(t, "task_id string, section string, seq long, piece string", [("a", "s", 2, "two"), ("a", "s", 1, "one "), ("a", "s", 2, "two")]))


@expect("kb VARCHAR", [("b",)])
def register_base_cases(t: Tables) -> DataFrame:
    return records.register_bases(table(t, "kb string", [("a",)]), table(t, "kb string", [("a",), ("b",), ("b",)]))


@expect("term VARCHAR, docs BIGINT, times BIGINT", [("ab", 2, 3), ("abc", 1, 1)])
def term_occurrence_cases(t: Tables) -> DataFrame:
    """Terms within words count, and ones that overlap."""
    return facts.term_occurrences(table(t, "doc_id int, text string", [(1, "xABcab"), (2, "ab"), (3, None)]), table(t, "term string", [("ab",), ("abc",), ("zz",), ("",)]))


@expect("a INT, b INT", [(1, 3)])
def similar_pair_cases(t: Tables) -> DataFrame:
    """1 and 2 have one set; 3 differs in a letter."""
    base = "the annual report on revenue and profit of the whole company group in detail"
    rows = [(1, base), (2, base.upper()), (3, base + "s"), (4, "something else entirely")]
    return similar.pairs(table(t, "id int, text string", rows), "text", "id", 0.75)[0]


@expect("query_id INT, rank INT, chunk_id VARCHAR", [(1, 1, "b"), (1, 2, "a"), (2, 1, "c"), (2, 2, "d"), (2, 3, "f")])
def document_limit_cases(t: Tables) -> DataFrame:
    """Two hits stand by score though both are of one document; of three or more each document gives two, the one with the larger sum first."""
    rows = [(1, "x", "a", 0.1, 2), (1, "x", "b", 0.2, 1), (2, "x", "c", 0.5, 1), (2, "x", "d", 0.4, 2), (2, "x", "e", 0.3, 3), (2, "y", "f", 0.6, 4)]
    return search.limit_per_doc(table(t, "query_id int, doc_id string, chunk_id string, rrf double, merge_pos int", rows), 3).select("query_id", "rank", "chunk_id")


@expect("query_id INT, segment INT, block VARCHAR", [(1, 1, "[1] doc=x section=S score=0.900\none\n\ntwo"), (1, 2, "[2] doc=y section=- score=0.500\n" + "z" * 900 + "…")])
def assemble_cases(t: Tables) -> DataFrame:
    """Neighbours join under the better score and the first one's section; a long chunk is clipped."""
    rows = [(1, "x", 3, 0.4, "S", " one "), (1, "x", 4, 0.9, "T", "two"), (1, "y", 0, 0.5, None, "z" * 950)]
    return context.assemble(table(t, "query_id int, doc_id string, chunk_index int, score double, section_path string, content string", rows))


@expect("doc_id INT, relevance DOUBLE, faithfulness DOUBLE, coherence DOUBLE, completeness DOUBLE", [(1, 1.0, 0.92, 0.0, 0.5), (2, 1.0, 0.5, 1.0, 1.0)])
def evaluate_cases(t: Tables) -> DataFrame:
    """.4 of the rule and .6 of the judge where he says something; repeated sections don't cohere."""
    rows = [(1, "## alpha beta\n## beta alpha", "alpha", 0.8, 0.5, '{"faithfulness": 5}'), (2, "人工智能", "人工智能", 0.5, 1.0, None)]
    return relevance.evaluate(table(t, "doc_id int, content string, prompt string, faithful double, covered double, judge string", rows))


@expect("id INT, md VARCHAR", [(0, "| Year | Sum |\n| --- | --- |\n| 2023 | 10 |\n| 2024 |  |"), (1, "")])
def hash_table_cases(t: Tables) -> DataFrame:
    return each(t, ["Year # Sum\n\n2023#10\n2024", " # "], X.hash_table, "md")


@expect("id INT, skips BOOLEAN", [(0, True), (1, False), (2, True), (3, False)])
def render_cases(t: Tables) -> DataFrame:
    """Nothing changed; a used key changed; an unused one did; a template without placeholders."""
    rows = table(t, "id int, t string, c array<string>", [(0, "{{a}}", []), (1, "{{a}}", ["a"]), (2, "{{a}}", ["b"]), (3, "plain", ["b"])])
    return rows.select("id", X.skips_render(F.col("t"), F.col("c")).alias("skips"))


@expect("id INT, calls VARCHAR", [(0, "rag:{\"q\":\"x\"}|chart:"), (1, "rag:"), (2, "")])
def skill_call_cases(t: Tables) -> DataFrame:
    texts = ['```json\n[{"skill": "rag", "args": {"q": "x"}}, {"skill": "chart"}, {"x": 1}]\n```', 'call {"skill": "rag"} now', "none"]
    return each(t, texts, lambda c: F.array_join(F.transform(X.skill_calls(c), lambda x: F.concat(x["skill"], F.lit(":"), F.coalesce(x["args"], F.lit("")))), "|"), "calls")


@expect("doc_id INT, marks INT, ids INT, top_id INT, top_share DOUBLE, repeat_paragraphs INT, placeholders INT, has_references BOOLEAN", [(1, 4, 2, 1, 0.75, 1, 1, True), (2, 0, 0, None, None, 0, 0, False)])
def citation_distribution_cases(t: Tables) -> DataFrame:
    return facts.citation_distribution(table(t, "doc_id int, text string", [(1, "甲【1】乙[1]\n\n丙【2】（材料暂缺数据）\n\n【1】\n## 参考文献"), (2, None)]))


@expect("file VARCHAR, title VARCHAR, summary VARCHAR, points VARCHAR", [("a", "T", "new", "p"), ("b", "B", "S", "x")])
def repair_cases(t: Tables) -> DataFrame:
    """Missing fields are filled, others stay; a file without a second answer is as it was."""
    old = table(t, "file string, title string, summary string, key_points array<string>", [("a", "T", " ", []), ("b", "B", "S", ["x"])])
    made = records.repair(old, table(t, "file string, title string, summary string, key_points array<string>", [("a", "other", "new", ["p"])]))
    return made.select("file", "title", "summary", F.array_join("key_points", "|").alias("points"))


@expect("id INT, n INT", [(0, 2), (1, 0)])
def atomic_fact_cases(t: Tables) -> DataFrame:
    rows = table(t, "id int, c string, a string", [(0, "x" * 100, "这是第一条事实\n短\n这是第二条事实"), (1, "x" * 99, "这是第一条事实")])
    return rows.select("id", F.size(review.atomic_facts(F.col("c"), F.col("a"))).alias("n"))


@expect("id INT, n INT, terms VARCHAR", [(1, 1, "c,d,e,f"), (1, 2, "z")])
def open_aspect_cases(t: Tables) -> DataFrame:
    """Half of the first three terms (one at least) must occur: a does, c, d and e don't, nor does z."""
    rows = [(1, 0, ["a", "b"], "a f"), (1, 1, ["c", "d", "e", "f"], "a f"), (1, 2, ["z"], "a f")]
    return review.open_aspects(table(t, "id int, pos int, terms array<string>, body string", rows)).select("id", "n", F.array_join("terms", ",").alias("terms"))


@expect("doc_id INT, n INT, field VARCHAR, value VARCHAR, type VARCHAR", [(1, 1, "TO", "Ada Lovelace", "NAME"), (1, 2, "TOTAL", "$ 45.20", "AMOUNT"), (1, 3, "NOTE", "late", "TEXT")])
def form_fusion_cases(t: Tables) -> DataFrame:
    """Slots first; the same pair of a later source counts once; another variant's layout helps as the first one has a single pair."""
    rows = [(1, "lines", 0, "to:", "ada lovelace"), (1, "slots", 0, "To", "Ada Lovelace"), (1, "layout", 0, "Total:", "$ 45.20"), (1, "layout2", 0, "Note", "late"), (1, "odd", 0, "x", "y")]
    return layout.fuse_pairs(table(t, "doc_id int, kind string, pos int, field string, value string", rows))


@expect("query_id INT, fast BOOLEAN", [(1, True), (2, False), (3, False)])
def fast_path_cases(t: Tables) -> DataFrame:
    """Three of four; two of two are too few; three of seven are under half."""
    rows = [(1, s) for s in (2, 2, 3, 0)] + [(2, 5), (2, 5)] + [(3, s) for s in (2, 2, 2, 0, 1, 1, 0)]
    return answering.fast_enough(table(t, "query_id int, score int", rows))


@expect("query_id INT, place INT, chunk_id VARCHAR, is_primary BOOLEAN, hit BOOLEAN", [(1, 1, "a", True, True), (1, 2, "b", True, True), (1, 3, "d", False, False), (1, 4, "c", True, True)])
def context_search_cases(t: Tables) -> DataFrame:
    """Hits by document and place with the chunk behind b, which two chunks a document keep out of the hits."""
    chunks, asked = _small(t)
    more = table(t, "kb string, doc_id int, chunk_id string, chunk_index int, section_path string, content string, embedding array<double>, updated_at timestamp", [("k", 1, "d", 2, "", "nothing here", [0.0, 0.5], None)])
    found = answering.search_with_context(chunks.union(more), asked, 8)
    return found.select("query_id", "place", "chunk_id", "is_primary", (F.col("score") > 0).alias("hit"))


@expect("doc_id INT, kind VARCHAR, next INT", [(1, "content", 4), (1, "outline", 2)])
def next_version_cases(t: Tables) -> DataFrame:
    return records.next_version(table(t, "doc_id int, kind string, version int", [(1, "content", 1), (1, "content", 3), (1, "outline", 1)]))
