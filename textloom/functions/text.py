"""Text expressions. All stay in the JVM; null and empty text mean the same, as in the row-oriented model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound(c: Column, f) -> Column:
    """f of c as a variable: what a function over elements says of c is then worked out once, not for each element."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clip(c: Column, n: int, mark: str = "…") -> Column:
    """At most n characters, then the mark."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Line ends to LF, no blanks at line ends, two line breaks in a row at most, trimmed."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def preprocess_text(c: Column, limit: int = 8000) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return clip(strip(c), limit)


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_kb(c: Column) -> Column:
    """Knowledge-base name: runs of other characters become one underscore; empty becomes 'default'."""
    c = F.regexp_replace(strip(text(c)), f"[^0-9A-Za-z{CJK}._-]+", "_")
    c = F.regexp_replace(c, "^[._]+|[._]+$", "")
    return F.when(c == "", F.lit("default")).otherwise(c)


def sentences(c: Column, least: int = 3) -> Column:
    """Sentences after CJK or Latin closing marks and at line ends."""
    parts = F.split(c, f"(?<=[。！？；\n])\\s*|(?<=[.!?;])\\s+(?=[A-Z{CJK}])")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= least)


def plain_sentences(c: Column, least: int = 8) -> Column:
    """Sentences for compression: between runs of closing marks and line ends."""
    return F.filter(F.transform(F.split(c, "[。！？.!?\n]+"), strip), lambda s: F.length(s) >= least)


def head_tail(c: Column, n: int = 2400) -> Column:
    """First and last half of a long text around an ellipsis line."""
    half = n // 2
    cut = F.concat(F.regexp_replace(F.substring(c, 1, half), r"\s+$", ""), F.lit("\n...\n"), F.regexp_replace(F.substring(c, -half, half), r"^\s+", ""))
    return F.when(F.length(c) <= n, c).otherwise(cut)


def lexical_terms(c: Column, limit: int = 12) -> Column:
    """Distinct lower-case terms of two characters or more, in order, `limit` at most."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([{CJK}a-z0-9]{{2,}})"), 1)), 1, limit)


def tokens(c: Column, width: int = 32) -> Column:
    """Letter-digit runs, clipped; CJK runs give their character pairs."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), 0)
    pairs = lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).otherwise(F.array(F.substring(r, 1, width)))))


def words(c: Column) -> Column:
    """Lower-case ASCII words of two characters or more, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{2,})"), 1))


def pieces(c: Column, n: int) -> Column:
    """Runs of n characters, in order; none of a shorter text."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))
    return bound(c, lambda s: F.when(F.length(s) >= n, cut(s)).otherwise(F.array().cast("array<string>")))


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces of the text without punctuation and spaces; a shorter one is its own."""
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    return bound(plain, lambda s: F.when(F.length(s) < 3, F.array_compact(F.array(F.when(s != "", s)))).otherwise(F.array_distinct(pieces(s, 3))))


def fingerprint(c: Column) -> Column:
    """Distinct three-character pieces of the text without punctuation, and `W:` pairs of neighbouring words of two characters or more."""
    s = F.lower(squash(text(c)))
    grams = pieces(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", ""), 3)
    own = F.filter(F.split(s, " "), lambda w: F.length(w) >= 2)
    pairs = bound(own, lambda ws: F.zip_with(ws, F.slice(ws, 2, 1 << 30), lambda a, b: F.concat(F.lit("W:"), a, F.lit("|"), b)))  # null behind the last
    return F.array_distinct(F.array_compact(F.concat(grams, pairs)))


def similarity_tokens(c: Column) -> Column:
    """Lower-case words of two characters or more and single CJK characters, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(f"[a-z0-9]{{2,}}|[{CJK}]"), 0))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))))


def language_flag(c: Column) -> Column:
    return F.when(F.substring(text(c), 1, 800).rlike("[A-Za-z]"), F.lit("en")).otherwise(F.lit("zh"))


def likely_title(c: Column) -> Column:
    """3 to 30 characters, no closing mark, at least half of them letters, digits or CJK."""
    s = strip(c)
    plain = F.length(F.regexp_replace(s, f"[^{CJK}A-Za-z0-9]", ""))
    return F.length(s).between(3, 30) & ~s.rlike("[。！？；;.!?，,：:]$") & (plain >= F.length(s) * 0.5)


def strip_non_headings(c: Column) -> Column:
    """Keeps heading and blank lines."""
    return strip(F.array_join(F.filter(F.split(c, "\n"), lambda x: (F.trim(x) == "") | x.rlike(r"^\s*#{1,6}\s")), "\n"))


def clean_output(c: Column) -> Column:
    """Drops code fences; headings of four or more marks become bold list items."""
    c = F.regexp_replace(c, r"(?m)^```[A-Za-z]*[ \t]*\n?", "")
    return strip(F.regexp_replace(c, r"(?m)^#{4,}[ \t]*(.+?)[ \t]*$", "- **$1**"))


def salvage_json(c: Column) -> Column:
    """The outermost object in a model's answer, if it parses; else an object with the raw output."""
    body = F.regexp_extract(F.regexp_replace(c, "(?m)^```[A-Za-z]*[ \t]*$", ""), r"(?s)(\{.*\})", 1)
    raw = F.to_json(F.struct(F.lit("invalid").alias("error"), c.alias("raw_output")))
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body).otherwise(raw)


def file_type(path: Column) -> Column:
    """image, pdf, text, excel, docx or pptx, by suffix; text if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kinds = {"image": ["png", "jpg", "jpeg", "bmp", "tiff", "tif", "webp", "gif"], "pdf": ["pdf"], "excel": ["xlsx", "xls", "csv"], "docx": ["docx", "doc"], "pptx": ["pptx", "ppt"]}
    out = F.lit("text")
    for kind, names in kinds.items():
        out = F.when(suffix.isin(names), F.lit(kind)).otherwise(out)
    return out


def valid_task_id(c: Column) -> Column:
    return text(c).rlike("^[0-9A-Za-z_-]{1,64}$")


def safe_filename(c: Column) -> Column:
    """The last path part without characters that file systems refuse."""
    c = F.regexp_replace(text(c), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(c, r'[\x00-\x1f<>:"|?*]+', "_"), r"^[ .]+|[ .]+$", "")


def file_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"^.*[/\\]", ""), r"(?i)\.(pdf|docx)$", "")


def upload_problem(name: Column, size: Column, suffixes: list[str], most: int = 50 << 20) -> Column:
    """Why an upload is refused, or null."""
    return (
        F.when(F.trim(text(name)) == "", F.lit("no name"))
        .when(~F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1)).isin(suffixes), F.lit("type"))
        .when(size > most, F.lit("size"))
    )


# Words of approximation in front of a figure, and units behind it.
APPROXIMATE = ["约", "大约", "近", "超过", "不足", "至少", "最多"]
UNITS = ["元", "美元", "亿", "万", "%", "％", "个", "人", "家", "次", "倍", "吨", "公斤", "千米", "公里", "米", "小时", "天", "年", "月"]
STREETS = ["st", "street", "ave", "avenue", "road", "rd", "blvd", "drive", "lane", "washington", "suite"]
# End of the fixed values.


def normalize_number(c: Column) -> Column:
    """A figure without a word of approximation in front and a unit behind."""
    bare = F.regexp_replace(strip(text(c)), rf"^(?:{'|'.join(APPROXIMATE)})\s*", "")
    return strip(F.regexp_replace(bare, rf"\s*[万亿千百]?\s*(?:{'|'.join(UNITS)})?$", ""))


def form_text(c: Column, field: bool = False) -> Column:
    """A form's text with separators as blanks and digits apart from letters; names of fields in capitals."""
    s = F.regexp_replace(F.regexp_replace(text(c), r"\s+", " "), r"^[ \-:;,]+|[ \-:;,]+$", "")
    s = F.regexp_replace(s, r"[_/\\|-]+", " ")
    s = F.regexp_replace(s, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.regexp_replace(F.upper(s), r"^[ \-:;,]+|[ \-:;,]+$", "") if field else s


def addresses(c: Column, most: int = 3) -> Column:
    """Lines of 12 characters or more with a number of three digits and a word of streets, with blanks behind their marks."""
    lines = F.transform(F.split(text(c), "\r?\n"), squash)
    street = lambda x: F.exists(F.array(*map(F.lit, STREETS)), lambda w: F.contains(F.lower(x), w))
    found = F.filter(lines, lambda x: (F.length(x) >= 12) & x.rlike("[0-9]{3,}") & street(x))
    apart = lambda x: F.regexp_replace(F.regexp_replace(x, r"([,.;:])(?=\S)", "$1 "), r"\b([A-Z])\.\s*([A-Z])\.", "$1. $2.")
    towards = lambda x: F.regexp_replace(x, r"\b([NSEW])\.\s*([NSEW])\.\s+([A-Z])", "$1. $2., $3")
    neat = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(towards(apart(x)), r"\s+", " "), "^[ ,]+|[ ,]+$", ""))
    return F.slice(F.array_distinct(neat), 1, most)


def keywords(c: Column, most: int = 18) -> Column:
    """CJK pairs and words of a question, then its technical terms, once each whatever their case."""
    runs = F.regexp_extract_all(text(c), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), 0)
    pairs = lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), pairs(r)).otherwise(F.array(r))))
    found = F.filter(F.concat(cut, F.regexp_extract_all(text(c), F.lit("[A-Za-z0-9_-]{2,}"), 0)), lambda x: F.length(x) >= 2)
    return F.slice(first_of_each(found, F.lower), 1, most)


def first_of_each(found: Column, key=lambda x: x) -> Column:
    """Elements whose key no element before them has."""
    return bound(found, lambda xs: bound(F.transform(xs, lambda x: key(x)), lambda ks: F.filter(xs, lambda x, i: F.array_position(ks, key(x)) == i + 1)))


def last_index(c: Column, mark: str) -> Column:
    """Where a mark stands last, from 0; -1 if nowhere."""
    at = F.position(F.lit(mark[::-1]), F.reverse(c))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at + 1 - len(mark))


def cut_block(c: Column, most: int = 900) -> Column:
    """A text of `most` characters at most: cut behind the last sentence or line if that lies beyond 60 % of it."""
    head = F.substring(c, 1, most)
    at = F.greatest(*[last_index(head, m) for m in ("。", ".\n", ".\r", "\n")])
    short = F.when(at > most * 0.6, F.concat(F.substring(head, F.lit(1), at + 1), F.lit("\n…"))).otherwise(F.concat(head, F.lit("…")))
    return F.when(F.length(c) > most, short).otherwise(c)


def key_entities(c: Column) -> Column:
    """What a paraphrase keeps: figures with units, runs of capitals, and words of change with their figure."""
    figures = F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?\s*(?:[万亿千百]?辆?|[%％]|[A-Za-z/]+)?"), 0)
    capitals = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z])[A-Z]{2,}(?:\d+)?(?![A-Za-z])"), 0)
    change = F.regexp_extract_all(c, F.lit(r"(?:同比|环比|增长|下降|提升|减少)\s*(?:\d+(?:\.\d+)?\s*%?)?"), 0)
    least = lambda found, n: F.filter(F.transform(found, strip), lambda x: F.length(x) >= n)
    return F.array_distinct(F.concat(least(figures, 2), capitals, least(change, 3)))


def merge_lines(a: Column, b: Column, most: int = 80) -> Column:
    """Lines of a text and then those of another, once each whatever their case and blanks; one alone as it is."""
    a, b = strip(text(a)), strip(text(b))
    lines = F.filter(F.transform(F.split(F.concat(a, F.lit("\n"), b), "\r?\n"), strip), lambda x: F.length(x) >= 2)
    once = first_of_each(lines, lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))
    return F.when(a == "", b).when(b == "", a).otherwise(F.array_join(F.slice(once, 1, most), "\n"))


def best_text(*texts: Column) -> Column:
    """The text of the best OCR quality, the first of equals; '' without any."""
    found = F.filter(F.transform(F.array(*texts), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    ranked = F.transform(found, lambda x, i: F.struct(ocr_quality(x).alias("q"), (-i).alias("at"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], F.lit(""))


def ocr_quality(c: Column) -> Column:
    """Lines, words and key-value lines count for a text; odd characters and long unspaced lines against it."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n_words = F.regexp_count(c, F.lit(f"[A-Za-z0-9]{{2,}}|[{CJK}]"))
    pairs = F.size(F.filter(lines, lambda x: x.rlike(r"^[^:：]{1,30}[:：]\s*\S")))
    odd = F.regexp_count(c, F.lit(r"[^\p{L}\p{N}\s.,:;!?()%/&'\"-]"))
    joined = F.size(F.filter(lines, lambda x: (F.length(x) >= 18) & ~x.rlike(r"[ :：]")))
    return 0.8 * F.least(F.size(lines), F.lit(40)) + 0.25 * F.least(n_words, F.lit(120)) + 1.2 * F.least(pairs, F.lit(30)) - 0.15 * odd - 1.6 * joined


def placeholders(c: Column) -> Column:
    """Distinct {{key}} names of a template."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), 1))


def render(template: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), text(value))
    return template


def table_markdown(headers: Column, rows: Column) -> Column:
    """A pipe table; ragged rows are padded."""
    width = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    cell = lambda x: F.replace(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), width), lambda i: cell(F.try_element_at(r, i.cast("int")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(width > 0, F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")).otherwise(F.lit(""))


def hash_table(c: Column) -> Column:
    """A pipe table of a text whose cells are parted by #; lines without cells go, shorter ones are padded."""
    rows = F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.filter(F.transform(F.split(x, "#"), strip), lambda y: y != "")), lambda r: F.size(r) > 0)
    body = lambda t: F.when(F.size(t) > 1, F.slice(t, 2, 1 << 30)).otherwise(F.array(F.array().cast("array<string>")))
    return bound(rows, lambda t: F.when(F.size(t) > 0, table_markdown(F.coalesce(F.try_element_at(t, F.lit(1)), F.array().cast("array<string>")), body(t))).otherwise(F.lit("")))


def skips_render(template: Column, changed: Column, drawn: bool = False) -> Column:
    """Whether a template needs no rendering: nothing changed, or none of its placeholders did; one without any, or one that is drawn by a program, is rendered."""
    keys = placeholders(text(template))
    untouched = (F.size(keys) > 0) & ~F.arrays_overlap(keys, changed) & F.lit(not drawn)
    return (F.size(changed) == 0) | untouched


def skill_calls(c: Column) -> Column:
    """Calls of skills in a model's JSON answer, one object or a list of them, as structs of skill and args (JSON text); none if it doesn't parse."""
    body = F.regexp_extract(F.regexp_replace(text(c), "(?m)^```[A-Za-z]*[ \t]*$", ""), r"(?s)(\[.*\]|\{.*\})", 1)
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    found = F.from_json(listed, "array<struct<skill:string,args:string>>")
    return F.filter(F.coalesce(found, F.array().cast("array<struct<skill:string,args:string>>")), lambda x: F.coalesce(x["skill"], F.lit("")) != "")


def dedup_line_citations(c: Column) -> Column:
    """Keeps only the first 【n】 with a number in each line."""

    def line(x: Column) -> Column:
        parts = F.split(x, "(?=【\\d+】)|(?<=】)")
        step = lambda acc, p: F.struct(
            F.concat(acc["out"], F.when(p.rlike("^【\\d+】$") & F.array_contains(acc["seen"], p), F.lit("")).otherwise(p)).alias("out"),
            F.when(p.rlike("^【\\d+】$"), F.array_union(acc["seen"], F.array(p))).otherwise(acc["seen"]).alias("seen"),
        )
        zero = F.struct(F.lit("").alias("out"), F.array().cast("array<string>").alias("seen"))
        return F.aggregate(parts, zero, step, lambda acc: acc["out"])

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def fill_placeholders(c: Column, phrase: str = "相关数据有待进一步补充") -> Column:
    """Remarks that something is missing become a plain phrase."""
    return F.regexp_replace(c, r"\[需补充[^\]]*\]|【需补充[^】]*】", phrase)


def text_year(meta: Column, doc: Column, content: Column) -> Column:
    """Year from metadata, else from the document's name, else from the text; '' if none."""
    year = lambda c: F.nullif(F.regexp_extract(text(c), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit(""))
    return F.coalesce(year(meta), year(doc), year(content), F.lit(""))
