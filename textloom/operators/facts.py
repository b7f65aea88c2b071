"""Facts in texts: extraction, cross-checks against sources, conflicts, repetition, citations, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of_each, strip, text

NUMBER = r"\d+(?:\.\d+)?%?"
YEAR = r"(?:19|20)\d{2}"


def numbers(c: Column) -> Column:
    """Distinct figures of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(NUMBER), 0), lambda x: F.length(x) >= 2))


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\b({YEAR})\b"), 1))


def organisations(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[一-鿿A-Za-z]{2,12}(?:公司|集团|大学|研究院|委员会|银行|部门|中心)"), 0))


def unsupported(claims: DataFrame, sources: DataFrame, fact: str = "fact") -> DataFrame:
    """Claims (id, fact) that no source (id, fact) of the same id has."""
    return claims.join(sources, ["id", fact], "left_anti")


def unsupported_organisations(claims: DataFrame, sources: DataFrame, n: int = 4) -> DataFrame:
    """Claims whose first n characters no source of the same id shares: an equi-join on the prefix."""
    prefix = F.substring("fact", 1, n)
    return claims.withColumn("p", prefix).join(sources.select("id", prefix.alias("p")).distinct(), ["id", "p"], "left_anti").drop("p")


# Forms of figures, institutions and years in claims and in materials.
CLAIMED = r"\d+(?:\.\d+)?\s*[万亿千百]?\s*(?:元|美元|亿|万|%|％|个|人|家|次|倍)"
STATED = [
    r"\d+(?:\.\d+)?\s*[万亿千百]?\s*(?:元|美元|亿|万|%|％|个|人|家|次|倍|吨|公斤|千米|公里|米|小时|天|年|月)", r"\d+(?:\.\d+)?\s*%", r"(?:约|大约|近|超过|不足|至少|最多)\s*\d+(?:\.\d+)?",
]
CLAIMED_ORGS = ["[一-鿿]{2,16}(?:公司|集团|大学|银行|医院|研究所|中心)", "[一-鿿]{2,8}(?:有限|股份)公司"]
STATED_ORGS = [
    "[一-鿿]{2,16}(?:公司|集团|大学|学院|研究所|研究院|中心|部门|委员会|协会|基金会|医院|银行|证券|保险|基金|科技|技术|网络|数据|人工智能|机器人)", "[一-鿿]{2,8}(?:有限|股份|责任|合资|独资)公司",
]
CLAIMED_YEAR, STATED_YEAR = r"(?:19|20|21)\d{2}", r"(?:19|20|21)\d{2}(?:[-—–/](?:19|20|21)?\d{2})?"
# End of the fixed values.


def found_in(c: Column, patterns: list[str], least: int = 2, most: int = 1 << 20) -> Column:
    """Distinct matches of the patterns in turn, of `least` to `most` characters."""
    every = F.concat(*[F.regexp_extract_all(text(c), F.lit(p), 0) for p in patterns])
    return F.array_distinct(F.filter(F.transform(every, strip), lambda x: F.length(x).between(least, most)))


def cross_check(texts: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, issues: figures, institutions (by four characters at their front) and years of texts (doc_id, body, materials) that the materials lack."""
    body, given = F.col("body"), F.col("materials")
    orgs = found_in(given, STATED_ORGS, 3, 24)
    near = lambda x: F.exists(orgs, lambda o: F.contains(o, F.substring(x, 1, 4)) | F.contains(x, F.substring(o, 1, 4)))
    lacks = lambda claims, known, mark: F.transform(F.array_except(claims, known), lambda x: F.concat(F.lit(mark), x))
    unknown = F.transform(F.filter(found_in(body, CLAIMED_ORGS), lambda x: ~near(x)), lambda x: F.concat(F.lit("机构:"), x))
    issues = F.concat(lacks(found_in(body, [CLAIMED], 3), found_in(given, STATED), "数字:"), unknown, lacks(found_in(body, [CLAIMED_YEAR]), found_in(given, [STATED_YEAR]), "年份:"))
    return texts.select("doc_id", F.when((strip(text("body")) == "") | (strip(text("materials")) == ""), F.array().cast("array<string>")).otherwise(F.slice(issues, 1, most)).alias("issues"))


def conflicts(claims: DataFrame, least: float = 0.01) -> DataFrame:
    """metric, docs, low, high of metrics (metric, doc_id, value) whose values differ by over `least` of the largest between documents."""
    per = claims.groupBy("metric").agg(F.count_distinct("doc_id").alias("docs"), F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.abs("value")).alias("top"))
    return per.where((F.col("docs") >= 2) & (F.col("high") - F.col("low") > least * F.col("top"))).select("metric", "docs", "low", "high")


def repeated_values(sections: DataFrame, more_than: int = 3) -> DataFrame:
    """fact, sections: figures in more than so many sections (id, text) of a document; years don't count."""
    rows = sections.select("doc_id", "section", F.explode(numbers(text("text"))).alias("fact")).where(~F.col("fact").rlike(f"^{YEAR}$"))
    return rows.groupBy("doc_id", "fact").agg(F.count_distinct("section").alias("sections")).where(F.col("sections") > more_than)


# Forms of comparing claims, and phrases that reports must not use.
CONTRASTS = {"优于": "(.{5,40})优于(.{5,40})", "高于": "(.{5,40})高于(.{5,40})", "相比更": "(.{5,40})相比(.{5,40})更(.{5,20})"}
BANNED = ["可验证", "未来可", "未来方向", "未来研究", "未来工作", "后续可", "后续探索", "后续验证", "后续研究", "后续工作"]
# End of the fixed values.


def contrastive(c: Column, most: int = 8) -> Column:
    """Comparing claims as structs of kind, left and right; those that agree in the first ten characters of both sides count once."""
    def claims(kind: str, p: str) -> Column:
        left, right = (F.transform(F.regexp_extract_all(text(c), F.lit(p), k), strip) for k in (1, 2))
        return F.zip_with(left, right, lambda a, b: F.struct(F.lit(kind).alias("kind"), a.alias("left"), b.alias("right")))

    found = F.concat(*[claims(kind, p) for kind, p in CONTRASTS.items()])
    key = lambda x: F.concat(F.substring(x["left"], 1, 10), F.substring(x["right"], 1, 10))
    return F.slice(first_of_each(found, key), 1, most)


def citation_issues(c: Column, least: int = 2, most: int = 20) -> Column:
    """What is wrong with the citations 【n】 of a section: missing (no mark at all, then nothing else), none, few, repeated
    (in a paragraph), bare (a reported source without a number in the 20 characters before it), half-width, range, style."""
    c = text(c)
    found = F.regexp_extract_all(c, F.lit("【(\\d+)】"), 1)
    ids = F.array_distinct(F.transform(found, lambda x: x.cast("int")))
    marks = lambda p: F.regexp_extract_all(p, F.lit("【(\\d+)】"), 1)
    repeated = F.exists(F.split(c, "\n"), lambda p: F.size(F.array_distinct(marks(p))) < F.size(marks(p)))
    near = "".join(rf"(?<!【\d{{{n}}}】[\s\S]{{0,{18 - n}}})" for n in range(1, 7))
    has = c.rlike("【") | c.rlike(r"\[\d+\]")
    issues = F.array_compact(F.array(
        F.when(F.size(ids) == 0, F.lit("none")).when(F.size(ids) < least, F.lit("few")),
        F.when(repeated, F.lit("repeated")),
        F.when(c.rlike(near + r"据[^\s，。；\n]{4,40}"), F.lit("bare")),
        F.when(c.rlike(r"(?<![【\[])\[(\d+)\](?![】\]])"), F.lit("half-width")),
        F.when(F.exists(ids, lambda i: i > most), F.lit("range")),
        F.when(F.exists(F.array(*map(F.lit, BANNED)), lambda w: F.contains(c, w)), F.lit("style")),
    ))
    return F.when(has, issues).otherwise(F.array(F.lit("missing")))


def citations(texts: DataFrame) -> DataFrame:
    """doc_id, pos, old_id: each citation in order."""
    found = F.transform(F.regexp_extract_all(text("text"), F.lit("【(\\d+)】"), 1), lambda x: x.cast("int"))
    return texts.select("doc_id", F.posexplode(found).alias("pos", "old_id"))


def renumbered(cites: DataFrame) -> DataFrame:
    """doc_id, old_id, new_id: ids in the order of their first occurrence."""
    first = cites.groupBy("doc_id", "old_id").agg(F.min("pos").alias("first"))
    return first.select("doc_id", "old_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("new_id"))


def renumber_text(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) with each 【old】 rewritten to its number by first occurrence, in one pass over the text."""
    parts = F.split(text("text"), "(?=【\\d+】)|(?<=】)")
    mark = lambda p: F.regexp_extract(p, "^【(\\d+)】$", 1)
    ids = F.array_distinct(F.filter(F.transform(parts, mark), lambda x: x != ""))
    new = F.transform(parts, lambda p: F.when(mark(p) != "", F.concat(F.lit("【"), F.array_position(ids, mark(p)).cast("string"), F.lit("】"))).otherwise(p))
    return texts.withColumn("text", F.array_join(new, ""))


def global_citations(cites: DataFrame) -> DataFrame:
    """doc_id, local_id, global_id of citations (doc_id, section, local_id, source, chunk_id): one number for each source and chunk, by section and local id."""
    order = Window.partitionBy("doc_id").orderBy("section", "local_id")
    rows = cites.withColumn("at", F.row_number().over(order))
    first = rows.groupBy("doc_id", "source", "chunk_id").agg(F.min("at").alias("first"))
    named = first.withColumn("global_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    return rows.join(named.drop("first"), ["doc_id", "source", "chunk_id"]).select("doc_id", "section", "local_id", "global_id", "source")


def reference_list(cites: DataFrame) -> DataFrame:
    """doc_id, references: lines 【i】name of the sources (doc_id, global_id, source), each once, without folders and suffixes."""
    from ..functions.text import file_label

    first = cites.where(F.trim(text("source")) != "").groupBy("doc_id", F.trim("source").alias("source")).agg(F.min("global_id").alias("first"))
    lines = first.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")))
    line = F.concat(F.lit("【"), F.col("i").cast("string"), F.lit("】"), file_label(F.col("source")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("references"))


def citation_contexts(texts: DataFrame, before: int = 60, after: int = 100) -> DataFrame:
    """doc_id, pos, old_id, context: each citation with the characters around it."""
    c = F.col("text")
    at = F.aggregate(
        F.split(c, "(?=【\\d+】)|(?<=】)"), F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,mark:string>>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(p.rlike("^【\\d+】$"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("mark"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )
    rows = texts.select("doc_id", text("text").alias("text")).select("doc_id", "text", F.posexplode(at).alias("pos", "x"))
    start = F.greatest(F.lit(1), F.col("x.at") - before)
    around = F.substring(F.col("text"), start, F.col("x.at") + F.length("x.mark") + after - start)
    return rows.select("doc_id", "pos", F.regexp_extract("x.mark", "(\\d+)", 1).cast("int").alias("old_id"), F.replace(around, F.lit("\n"), F.lit(" ")).alias("context"))


def citation_distribution(texts: DataFrame) -> DataFrame:
    """doc_id, marks, ids, top_id, top_share, repeat_paragraphs, placeholders, has_references of texts with citations in either brackets."""
    mark = r"[【\[](\d+)[】\]]"
    ids = F.regexp_extract_all(text("text"), F.lit(mark), 1)
    again = F.filter(F.split(text("text"), "\n\n"), lambda p: F.size(F.array_distinct(F.regexp_extract_all(p, F.lit(mark), 1))) < F.size(F.regexp_extract_all(p, F.lit(mark), 1)))
    rows = texts.select(
        "doc_id", ids.alias("found"), F.size(again).alias("repeat_paragraphs"), F.regexp_count(text("text"), F.lit("[（(]材料[暂缺不].*?[）)]")).alias("placeholders"), F.contains(text("text"), F.lit("## 参考文献")).alias("has_references"),
    )
    per = rows.select("doc_id", F.explode("found").alias("id")).groupBy("doc_id", F.col("id").cast("int").alias("id")).agg(F.count("*").alias("n"))
    top = per.groupBy("doc_id").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("top_id"), F.max("n").alias("n"))
    out = rows.join(top, "doc_id", "left")
    return out.select("doc_id", F.size("found").alias("marks"), F.size(F.array_distinct("found")).alias("ids"), "top_id", F.round(F.col("n") / F.size("found"), 6).alias("top_share"), "repeat_paragraphs", "placeholders", "has_references")


def suspicious_citations(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, pos, old_id, issue: citations without a source (doc_id, old_id, snippet), or whose surroundings share no entity with it."""
    from ..functions.text import key_entities

    rows = citation_contexts(texts).join(sources.select("doc_id", "old_id", F.replace(text("snippet"), F.lit("\n"), F.lit(" ")).alias("snippet")), ["doc_id", "old_id"], "left")
    own = key_entities(F.col("snippet"))
    apart = (F.size(own) > 0) & (F.size(F.array_intersect(own, key_entities(F.col("context")))) == 0)
    issue = F.when(F.col("snippet").isNull(), "fake_citation").when(apart, "no_entity_overlap")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("doc_id", "pos", "old_id", "issue")


def fake_citations(cites: DataFrame, known: DataFrame) -> DataFrame:
    """Citations whose id the map (doc_id, old_id) lacks."""
    return cites.join(known.select("doc_id", "old_id").distinct(), ["doc_id", "old_id"], "left_anti")


def outline(texts: DataFrame) -> DataFrame:
    """doc_id, order_index, level, title, parent_title of Markdown headings."""
    rows = texts.select("doc_id", F.posexplode(F.split(text("text"), "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.select("doc_id", "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))
    rows = rows.withColumn("order_index", F.row_number().over(w) - 1)
    last = [F.last(F.when(F.col("level") == n, F.struct("pos", "title")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n in range(1, 6)]
    above = F.array(*[F.when(F.lit(n) < F.col("level"), x) for n, x in zip(range(1, 6), last, strict=True)])
    parent = F.array_max(F.array_compact(above))  # the heading above that comes last, of a smaller level
    return rows.select("doc_id", "order_index", "level", "title", F.coalesce(parent["title"], F.lit("")).alias("parent_title"))


def numbered(headings: DataFrame) -> DataFrame:
    """headings with number 1.2.3; level 1 counts only if there are several."""
    order = Window.partitionBy("doc_id").orderBy("order_index")
    many = F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("doc_id")) > 1
    rows = headings.withColumn("many", many)
    for n in range(1, 4):
        rows = rows.withColumn(f"g{n}", F.sum((F.col("level") < n).cast("int")).over(order))
    for n in range(1, 4):
        rows = rows.withColumn(f"n{n}", F.sum((F.col("level") == n).cast("int")).over(Window.partitionBy("doc_id", f"g{n}").orderBy("order_index")))
    parts = [F.when((F.col("level") >= n) & (F.col("many") | F.lit(n > 1)), F.col(f"n{n}").cast("string")) for n in range(1, 4)]
    return rows.select("doc_id", "order_index", "level", "title", F.concat_ws(".", *parts).alias("number"))


def key_values(texts: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, pos, field, value of `key: value` lines; the first of a pair that differs by case only, `most` a document."""
    rows = texts.select("doc_id", F.posexplode(F.split(text("text"), "\n")).alias("pos", "line"))
    pattern = r"^\s*([^:：|]{1,40}?)\s*(?:[:：]\s*|\s{2,})(\S.*)$"
    rows = rows.select("doc_id", "pos", strip(F.regexp_extract("line", pattern, 1)).alias("field"), strip(F.regexp_extract("line", pattern, 2)).alias("value")).where("field <> '' AND value <> ''")
    first = Window.partitionBy("doc_id", F.lower("field"), F.lower("value")).orderBy("pos")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("k") <= most).drop("k")


def term_frequency(texts: DataFrame, toks: Column, most: int, stop: list[str] | None = None) -> DataFrame:
    """doc_id, term, tf, rank: each row's frequent terms of two characters or more, ties to the earlier one. A row is counted where it lies, without a shuffle."""
    import pyarrow as pa

    kind, unwanted = dict(texts.dtypes)["doc_id"], frozenset(stop or ())

    def run(batches):
        for batch in batches:
            at, terms, tf, rank = [], [], [], []
            for k, found in enumerate(batch.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for t in found or ():
                    if len(t) > 1 and t not in unwanted:
                        counts[t] = counts.get(t, 0) + 1
                best = sorted(counts.items(), key=lambda x: -x[1])[:most]  # stable: the earlier one first
                at += [k] * len(best)
                terms += [t for t, _ in best]
                tf += [n for _, n in best]
                rank += range(1, len(best) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(rank, pa.int32())], names=["doc_id", "term", "tf", "rank"])

    return texts.select("doc_id", toks.alias("toks")).mapInArrow(run, f"doc_id {kind}, term string, tf long, rank int")


def shared_terms(terms: DataFrame, least: int = 3) -> DataFrame:
    """doc_a, doc_b, common: documents with `least` common terms or more, by an equi-join on the term."""
    a, b = terms.select(F.col("doc_id").alias("doc_a"), "term"), terms.select(F.col("doc_id").alias("doc_b"), "term")
    return a.join(b, "term").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count("*").alias("common")).where(F.col("common") >= least)


def rare_overlaps(terms: DataFrame, rare: int = 20, least: int = 3) -> DataFrame:
    """doc_a, doc_b, common: documents that have `least` common terms of those that 2 to `rare` documents hold, from distinct (doc_id, term).

    What makes two texts overlap are terms that few others have; those of many are in all of them. So only lists of `rare`
    documents are paired, and the pairs grow with the terms, however frequent some are. A term's list is never longer than `rare`.
    """
    counted = terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n").between(2, rare)).select("term")
    lists = terms.join(counted, "term").groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    later = lambda x, i: F.transform(F.slice("docs", i + 2, rare), lambda y: F.struct(x.alias("doc_a"), y.alias("doc_b")))
    pairs = lists.select(F.explode(F.flatten(F.transform("docs", later))).alias("p")).select("p.*")
    return pairs.groupBy("doc_a", "doc_b").agg(F.count("*").alias("common")).where(F.col("common") >= least)


def term_occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, docs, times: in how many texts (doc_id, text) a term stands, and how often (overlaps too), also within words. Terms are a
    stated set; one automaton of a block of them reads each text once, and a task hands on a row for each term it met."""
    import ahocorasick
    import pyarrow as pa

    from .search import in_blocks

    parts = []
    for block in in_blocks(terms.select("term").where("term <> ''").distinct(), ["term"]):
        sent = docs.sparkSession.sparkContext.broadcast([r["term"] for r in block])

        def run(batches, sent=sent):
            automaton = ahocorasick.Automaton()
            for t in sent.value:
                automaton.add_word(t, t)
            counts: dict[str, list[int]] = {}
            if sent.value:
                automaton.make_automaton()
                for batch in batches:
                    for body in batch.column(0).to_pylist():
                        met: dict[str, int] = {}
                        for _, t in automaton.iter(body):
                            met[t] = met.get(t, 0) + 1
                        for t, k in met.items():
                            own = counts.setdefault(t, [0, 0])
                            own[0] += 1
                            own[1] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "docs", "times"])

        parts.append(docs.select(F.lower(text("text")).alias("text")).mapInArrow(run, "term string, docs long, times long"))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    return found.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
