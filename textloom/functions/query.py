"""What a question looks like: flags, kinds and intents as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, first_of_each, strip, text

# The keywords that the rules of the application are made of.
ABSTRACT = ["为什么", "原因", "影响", "趋势", "发展", "前景", "意义", "作用", "分析", "评估", "判断", "看法", "观点", "理解", "解释"]
CONCRETE = ["多少", "什么时间", "在哪里", "谁", "哪个", "编号", "日期", "金额", "比例", "百分比", "步骤", "流程", "定义"]
CONCEPTUAL = ["是什么", "什么是", "应该是", "如何定义", "定义", "概念", "框架", "体系", "结构", "组成", "特征", "特点", "特性", "怎样的", "怎么样"]
COMPARISON = ["比较", "对比", "区别", "异同", "vs", "VS", "优缺点"]
SUMMARY = ["总结", "汇总", "概述", "概括", "归纳"]
HOW_TO = ["怎么", "如何", "步骤", "流程", "方法", "操作"]
SLASH = ["help", "h", "status", "st", "pause", "resume", "cancel", "stop", "regen", "regenerate", "prompt", "prompt!", "kb", "files", "templates", "template", "append"]
MODIFY = [
    "太长", "太短", "精简", "缩短", "删", "删除", "去掉", "移除", "增加", "添加", "补充", "加入", "扩展", "展开", "详细",
    "修改", "调整", "更改", "换成", "替换", "改成", "优化", "改进", "改善", "重点", "侧重", "强调", "突出", "多写", "少写",
    "减少", "扩充", "缩减", "重写", "重新", "重做", "再生成", "不对", "不好", "不行", "不对的", "有问题", "错误", "换一个",
    "另一种", "换个", "换个风格", "太啰嗦", "太繁琐", "太简略", "太笼统", "太抽象", "太具体", "数据", "图表", "案例", "分析", "对比",
]
CONTROL = [
    "帮助", "怎么用", "如何使用", "你能做什么", "有哪些功能", "可用功能",
    "查看.*(?:状态|进度)", "当前.*(?:状态|进度)", "任务.*(?:状态|进度)", "现在.*到哪", "进行到哪", "完成了?吗",
    "暂停", "先停一下", "先别继续", "等一下再",
    "继续(?:生成|写|执行)?", "恢复(?:生成|写|执行)?", "接着(?:生成|写|执行)?",
    "取消(?:任务|生成)?", "停止(?:任务|生成)?", "终止(?:任务|生成)?", "不用生成了", "先别生成了",
    "重新生成", "重新来", "再生成", "重做", "从头生成", "重写一版",
    "查看.*(?:文件|材料)", "上传了哪些(?:文件|材料)", "现在有哪些(?:文件|材料)",
    "查看.*模板", "有哪些模板", "模板列表", "怎么追加", "追加.*(?:文件|材料|模板)", "继续上传",
    "(?:列出|看看|查看).*(?:所有)?知识库", "有哪些知识库", "知识库列表", "(?:新建|创建|新增).*(?:知识库|资料库)",
    "(?:切换到|切到|使用|启用|选择|改用).{0,30}(?:知识库|资料库)", "(?:不用|不使用|关闭|取消|清除|别用).*(?:知识库|资料库)", "不要查知识库",
    "(?:知识库|资料库).*(?:有哪些(?:文档|资料|文件)|文档列表|资料列表|文件列表)", "(?:列出|查看|看看).*(?:知识库|资料库).*(?:文档|资料|文件)",
    "(?:知识库|资料库).*(?:统计|文档数|chunk数|规模|情况)", "(?:删除|移除).*(?:知识库|资料库)",
    "(?:在|从|用).{0,30}(?:知识库|资料库).*(?:查一下|查|搜索|检索|搜一下|帮我查|帮我找|回答|说明|解释)",
    "(?:在)?(?:知识库|资料库)(?:里|中)?.*(?:查一下|查|搜索|检索|搜一下|帮我查|帮我找)",
]
KB = ["知识库", "资料库", "文档库", "有没有文档", "有没有资料", "有没有文件", "查一下", "搜一下", "检索", "搜索", "帮我查", "帮我找", "帮我搜"]
KB_CONCEPT = ["是什么", "什么是", "怎样", "如何", "怎么", "为什么", "定义", "概念", "用途", "作用", "价值", "特点", "特征", "介绍一下", "解释一下", "说明一下", "有什么用", "能做什么", "可以用来", "怎么用"]
GREETINGS = ["在吗", "在不在", "在了吗", "在不在呀", "你好", "您好", "你好啊", "嗨", "hi", "hello", "hey", "早上好", "下午好", "晚上好", "晚安", "中午好", "谢谢", "谢谢你", "感谢", "thx", "thanks", "thank you"]
STRONG_VERBS = ["优化", "修改", "重写", "删", "删除", "重做", "替换", "改成"]
QUESTION_WORDS = ["什么", "怎么", "如何", "为什么", "是否", "能不能", "可不可以", "请解释", "请说明"]
COMMANDS = ["优化", "修改", "重写", "删", "重做", "替换", "改成", "去掉", "移除"]
TRIVIAL_SHORT = ["hi", "ok", "好", "行", "是", "对", "嗯", "有", "no", "go", "嗯嗯"]
NOISE = ["喂", "喂喂", "有人吗", "在吗在吗", "test", "测试", "testing", "？？", "？？？", "?", "??", "???", "。。。", "…"]
HELLO = ["在吗", "在不在", "在了吗", "在不在呀", "你好", "您好", "你好啊", "嗨", "hi", "hello", "hey", "早上好", "下午好", "晚上好", "晚安", "中午好"]
THANKS = ["我喜欢你", "我爱你", "爱你", "能叫我宝贝吗", "叫我宝贝", "你真棒", "太棒了", "厉害", "牛逼", "谢谢", "谢谢你", "感谢", "thx", "thanks", "thank you"]
COMPLEX = ["为什么", "如何", "怎么", "原因", "影响", "关系", "对比", "区别", "比较", "优劣", "优缺点", "分析", "vs", "VS", " versus ", "相比", "不同", "差异", "是否", "应该", "如果", "假设", "评估", "判断"]
REASONING = ["为什么", "原因", "影响", "关系", "对比", "区别", "比较", "优劣", "优缺点", "分析", "vs", "VS", " versus ", "是否", "应该", "如果", "假设", "评估", "判断", "趋势", "归纳", "总结", "概括"]
STOP_CHARACTERS = "的了吗呢吧啊是都在和与或对从到用把被让给为以而因但就这那也都还没又再很更太只就可会要能说看想他她它我你"
EVALUATIONS = ["对比实验", "基线比较", "性能评估", "实验结果"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
PHONE_FIELDS = ["PHONE", "FAX", "TEL"]
AMOUNT_FIELDS = ["PRICE", "AMOUNT", "TOTAL", "COST"]
STREET_WORDS = ["street", "st", "road", "rd", "ave", "avenue", "blvd", "drive", "lane", "suite", "boulevard", "路", "街"]
KB_NONE = "(?:不用|不使用|关闭|取消|清除|别用).*(?:知识库|资料库)|不要查知识库"
KB_MADE = "(?:新建|创建|新增)(.*?)(?:知识库|资料库)"
KB_ASKED = "(?:在|从|用)\\s*(.{0,30}?)(?:知识库|资料库)(?:里|中)?.*?(?:查一下|帮我查|帮我找|搜一下|搜索|检索|查)"
KB_QUESTION = "^.*?(?:查一下|帮我查|帮我找|搜一下|搜索|检索|查)"
KB_USED = "(?:切换到|切到|使用|启用|选择|改用)(.{0,30}?)(?:知识库|资料库)"
KB_GONE = "(?:删除|移除)(.*?)(?:知识库|资料库)"
KB_LISTED = "有哪些知识库|知识库列表|(?:列出|看看|查看).*知识库"
ENTITIES = [
    r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}年(?:\d{1,2}月)?", r"\d+\.?\d*%", r"(?:USD|RMB|EUR|JPY|CNY)\s*\d+\.?\d*",
    r"\d+\.?\d*\s*(?:元|万元|亿美元|万元人民币)", r"[A-Z]{2,}[-一-鿿]*\d*[A-Z]*", r"[A-Z]+/[A-Z]+(?:\d+\.?\d*)?", r"第[一二三四五六七八九十\d]+[章节条款项]",
]
# End of the fixed values.


def any_of(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))


def hits(c: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)))


def has_numbers(c: Column) -> Column:
    return c.rlike(r"\d")


def has_tech(c: Column) -> Column:
    """Runs of capitals, which also covers abbreviations and units."""
    return c.rlike("[A-Z]{2,}|[A-Z]+/[A-Z]+")


def has_specialized_terms(tokens: Column) -> Column:
    """Three or more tokens of two to six characters without function characters."""
    return F.size(F.filter(tokens, lambda t: F.length(t).between(2, 6) & ~t.rlike("[的了吗呢吧啊嗯是都在和与或对从到用把被让给为以而因但]"))) >= 3


def concreteness(c: Column) -> Column:
    a, b = hits(c, ABSTRACT), hits(c, CONCRETE)
    return F.when(a + b == 0, F.lit(0.5)).otherwise(b / (a + b))


def profile(c: Column) -> Column:
    return F.struct(has_numbers(c).alias("has_numbers"), has_tech(c).alias("has_tech_terms"), concreteness(c).alias("concreteness"), F.length(c).alias("length"))


def classify(c: Column, fallback: Column | None = None) -> Column:
    """Kind of question; what no rule knows is the fallback's (a model's answer), else fact_lookup."""
    q = strip(text(c))
    valid = ["conceptual", "fact_lookup", "comparison", "summary", "multi_document", "how_to"]
    rest = F.lit("fact_lookup") if fallback is None else F.when(F.lower(F.trim(fallback)).isin(valid), F.lower(F.trim(fallback))).otherwise("fact_lookup")
    return (
        F.when(F.length(q) < 5, "fact_lookup")
        .when(any_of(q, CONCEPTUAL), "conceptual")
        .when(any_of(q, COMPARISON), "comparison")
        .when(any_of(q, SUMMARY), "summary")
        .when(any_of(q, HOW_TO), "how_to")
        .otherwise(rest)
    )


def entities(c: Column) -> Column:
    """Dates, figures, codes and references, distinct, in the order of the patterns; then what stands in quotation marks."""
    found = F.concat(*[F.regexp_extract_all(text(c), F.lit(p), 0) for p in ENTITIES], F.regexp_extract_all(text(c), F.lit("[“”\"「」『』'](.+?)[“”\"「」『』']"), 1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: F.length(x) >= 2))


def trivial(c: Column) -> Column:
    """What kind of small talk a message is (empty, short, noise, greeting, thanks); null if it needs an answer."""
    m = strip(text(c))
    low = F.lower(m)
    return (
        F.when(m == "", "empty")
        .when((F.length(m) <= 2) & ~low.isin(TRIVIAL_SHORT), "short")
        .when(low.isin(NOISE), "noise")
        .when(low.isin(HELLO), "greeting")
        .when(low.isin(THANKS), "thanks")
    )


def is_complex(c: Column) -> Column:
    """Whether an answer needs reasoning: over 60 characters, or a word of it."""
    q = strip(text(c))
    return (F.length(q) > 60) | any_of(q, COMPLEX)


def wants_hypothesis(c: Column) -> Column:
    """Whether a hypothetical answer is worth a model call: 15 characters or more, with a word of analysis."""
    q = strip(text(c))
    return (F.length(q) >= 15) & any_of(q, REASONING)


def terms(c: Column, least: int = 2, most: int = 8) -> Column:
    """Terms of a title or question in order: tokens without stop characters and bare figures."""
    from .text import tokens

    return first_of_each(F.filter(tokens(text(c)), lambda t: F.length(t).between(least, most) & ~t.rlike(f"^[{STOP_CHARACTERS}]$") & ~t.rlike(r"(?U)^[\d\W]+$")))


def longest_first(found: Column) -> Column:
    """Terms by falling length, equal lengths by code points."""
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])


def acronyms(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit("[A-Z]{2,}(?:-[A-Z]+)?"), 0)


def concepts(c: Column) -> Column:
    """Acronyms of a title, then its terms, the longer ones first."""
    return first_of_each(F.concat(acronyms(strip(text(c))), longest_first(terms(c))))


def usable_queries(found: Column, most: int) -> Column:
    """Distinct queries of 2 to 50 characters."""
    return F.slice(first_of_each(F.filter(F.transform(found, strip), lambda x: F.length(x).between(2, 50))), 1, most)


def expanded(c: Column, most: int = 4) -> Column:
    """A question, the first of its terms joined, its terms one by one, its acronyms alone and as a technique."""
    q = strip(text(c))
    t = terms(q)
    joined = lambda n: F.when(F.size(t) >= n, F.array(F.array_join(F.slice(t, 1, n), " "))).otherwise(F.array().cast("array<string>"))
    caps = F.flatten(F.transform(F.slice(acronyms(q), 1, 3), lambda a: F.array(a, F.concat(a, F.lit("技术")))))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(usable_queries(F.concat(F.array(q), joined(2), joined(3), F.slice(t, 1, 4), caps), most))


def point_queries(point: Column, title: Column, most: int = 8) -> Column:
    """Queries for a knowledge point: itself, its longest terms, acronyms and concepts of the section, and looks for evaluations."""
    kp, t = strip(text(point)), strip(text(title))
    own = concepts(t)
    caps, rest = F.filter(own, lambda x: x.rlike("^[A-Z]{2,}$")), F.filter(own, lambda x: ~x.rlike("^[A-Z]{2,}$"))
    whole = F.when(F.length(kp) >= 10, F.array(kp)).otherwise(F.array().cast("array<string>"))
    looks = F.flatten(F.transform(F.array(*map(F.lit, EVALUATIONS)), lambda e: F.array_compact(F.array(
        F.when(t != "", F.substring(F.concat(t, F.lit(" "), e), 1, 50)), F.when(F.length(kp) >= 6, F.substring(F.concat(F.substring(kp, 1, 40), F.lit(" "), e), 1, 50)),
    ))))
    return usable_queries(F.concat(whole, F.slice(longest_first(terms(kp)), 1, 3), F.slice(caps, 1, 2), F.slice(rest, 1, 2), looks), most)


def listed(answer: Column, least: int) -> Column:
    """Lines of a model's list without their numbers, of `least` characters or more."""
    lines = F.transform(F.split(text(answer), "\r?\n"), lambda x: strip(F.regexp_replace(x, r"^\d+[.)、\s]*", "")))
    return F.filter(lines, lambda x: F.length(x) >= least)


def rewritten(question: Column, answer: Column, shortest: int = 8, least: int = 4) -> Column:
    """A model's wording of a question, if the question is long enough to need one and the answer to be one. Step-back: 15 and 6."""
    q, a = strip(text(question)), strip(text(answer))
    return F.when((F.length(q) >= shortest) & (F.length(a) >= least), a).otherwise(q)


def variants(question: Column, answer: Column, most: int = 3) -> Column:
    """Distinct wordings that a model lists; the question itself if it is short or none is listed."""
    q = strip(text(question))
    found = listed(answer, 4)
    once = F.slice(first_of_each(found, F.lower), 1, most)
    return F.when((F.length(q) >= 6) & (F.size(found) > 0), once).otherwise(F.array(q))


def subquestions(question: Column, answer: Column) -> Column:
    """Parts of a question that a model lists; the question itself under 20 characters, or where the answer is SIMPLE."""
    q, a = strip(text(question)), strip(text(answer))
    found = listed(a, 5)
    return F.when((F.length(q) < 20) | (a == "") | F.upper(a).startswith("SIMPLE") | (F.size(found) == 0), F.array(q)).otherwise(found)


def hypothesis(question: Column, answer: Column) -> Column:
    """The text to embed for a question: a hypothetical answer of 15 characters or more, its first 600."""
    q, a = strip(text(question)), strip(text(answer))
    return F.when((F.length(q) >= 10) & (F.length(a) >= 15), F.substring(a, 1, 600)).otherwise(q)


def metadata_filters(question: Column, answer: Column) -> Column:
    """doc_type, source and time_range of a model's JSON answer, null where it has none."""
    a = strip(text(answer))
    ok = (F.length(strip(text(question))) >= 6) & a.startswith("{")
    part = lambda k: F.when(ok, F.nullif(strip(F.get_json_object(a, f"$.{k}")), F.lit(""))).alias(k)
    return F.struct(part("doc_type"), part("source"), part("time_range"))


def is_greeting(c: Column) -> Column:
    return F.lower(strip(text(c))).isin(GREETINGS)


def is_modification(m: Column) -> Column:
    asks = m.rlike("[?？]") | (m.endswith("吗") & (F.length(m) <= 20) & ~any_of(m, STRONG_VERBS))
    return (m != "") & (F.length(m) <= 120) & ~m.startswith("/") & any_of(m, MODIFY) & ~asks


def is_kb_query(m: Column) -> Column:
    return any_of(m, KB) | (any_of(m, ["文档", "资料"]) & (F.length(m) <= 60)) | any_of(m, KB_CONCEPT)


def is_question(m: Column) -> Column:
    starts = F.exists(F.array(*map(F.lit, QUESTION_WORDS)), lambda w: m.startswith(w))
    return (m != "") & (starts | m.rlike("[?？]") | (m.endswith("吗") & (F.length(m) <= 30)) | ((F.length(m) <= 60) & ~any_of(m, COMMANDS)))


def intent(message: Column, has_report: Column, clarifying: Column) -> Column:
    """Chat intent: commands, clarification, greetings, control, changes, knowledge base, questions, talk."""
    m = strip(text(message))
    command = F.lower(F.regexp_extract(m, r"^/(\S*)", 1))
    return (
        F.when(m == "", "general_chat")
        .when(m.startswith("/"), F.when(command.isin(SLASH), "control_task").otherwise("general_chat"))
        .when(clarifying, F.when(F.lower(m).isin("hi", "hello", "你好", "在吗"), "general_chat").otherwise("clarify_answer"))
        .when(is_greeting(m), "general_chat")
        .when(m.rlike("(?i)" + "|".join(CONTROL)), "control_task")
        .when(has_report & is_modification(m), "modify_report")
        .when(is_kb_query(m), "kb_query")
        .when(has_report & is_question(m), "question_report")
        .otherwise("general_chat")
    )


def kb_action(message: Column) -> Column:
    """What a message asks of a knowledge base: struct of type, kb and question."""
    m = strip(text(message))
    name = lambda p: strip(F.regexp_replace(F.regexp_extract(m, p, 1), r"^(?:一个|一下|到|为)|[的\s]+$", ""))
    row = lambda kind, kb, q="": F.struct(F.lit(kind).alias("type"), kb.alias("kb") if isinstance(kb, Column) else F.lit(kb).alias("kb"), (q if isinstance(q, Column) else F.lit(q)).alias("question"))
    return (
        F.when(m.rlike(KB_NONE), row("kb_clear", ""))
        .when(m.rlike(KB_MADE), row("kb_create", name(KB_MADE)))
        .when(m.rlike(KB_ASKED), row("kb_ask", name(KB_ASKED), strip(F.regexp_replace(m, KB_QUESTION, ""))))
        .when(m.rlike(KB_USED), row("kb_use", name(KB_USED)))
        .when(m.rlike(KB_GONE), row("kb_delete", name(KB_GONE)))
        .when(m.rlike(KB_LISTED), row("kb_list", ""))
        .otherwise(row("none", ""))
    )


def field_type(field: Column, value: Column) -> Column:
    """EMAIL, DATE, PHONE, AMOUNT, ADDRESS, NAME or TEXT of a form's pair; the first that fits."""
    f, v = F.upper(strip(text(field))), strip(text(value))
    low, one = F.lower(v), "|".join
    return (
        F.when(v.rlike(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "EMAIL")
        .when(low.rlike(rf"\b(?:{one(MONTHS)})\b") | v.rlike(r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"), "DATE")
        .when(any_of(f, PHONE_FIELDS) | (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7), "PHONE")
        .when(v.rlike(r"[$€¥£]|(?:^|\s)\d[\d,]*(?:\.\d+)?(?:\s|$)") & any_of(f, AMOUNT_FIELDS), "AMOUNT")
        .when(low.rlike(rf"(?U)\d{{2,}}.*\b(?:{one(STREET_WORDS)})\b"), "ADDRESS")
        .when(v.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$") & ~v.rlike(r"\d"), "NAME")
        .otherwise("TEXT")
    )


def chunk_size(title: Column) -> Column:
    """Target and overlap of chunks by words in a title; explicit arguments of a caller go first."""
    t = F.lower(text(title))
    size = lambda a, b: F.struct(F.lit(a).alias("target"), F.lit(b).alias("overlap"))
    return F.when(any_of(t, ["论文", "研究", "paper"]), size(1000, 150)).when(any_of(t, ["手册", "制度", "manual", "policy"]), size(700, 120)).otherwise(size(700, 100))
