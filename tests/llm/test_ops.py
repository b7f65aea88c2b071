"""The corpus operators on small tables: edge cases, and brute force where SQL can't say it."""

import hashlib
import random
import time
import unicodedata
import zlib

import numpy as np
import pytest
import sentencepiece
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import langid, line_dedup, media, packing, pieces, quality, simhash, substring_dedup, token_counts, topk
from textloom.llm.common import Scratch, components

from ..compare import same
from ..conftest import SF

SLOW = 2  # machines may be so much slower than usual
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch int, lost_keys string, name string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, *more, *([None] * (6 - len(more)))) for d, t, *more in rows], DOCS)


ODD = [(3, None), (1, ""), (2, " \n\t "), (None, "words without a number at all here"), (4, "same text twice"), (4, "same text twice"), (5, "x" * 300_000), (6, "é日🦄\x00\x1c　 ﬁ\r\n"), (7, "word " * 4000)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


DIGESTS = {
    "lines": line_dedup.line_dedup_digest, "substrings": substring_dedup.substring_dedup_digest, "pieces": pieces.encode_digest, "packing": packing.pack, "media": media.media_digest,
    "simhash": simhash.near_duplicates, "counts": lambda d: token_counts.apply_edits(token_counts.redactions(token_counts.trees(d)), with_text=False),
    "language": lambda d: langid.predictions(d, langid.learn(d)), "quality": lambda d: quality.scores(d, np.zeros(quality.BUCKETS + 2)),
}


@pytest.mark.parametrize("name", DIGESTS)
def test_odd_rows_and_empty_tables(spark, name):
    assert DIGESTS[name](docs(spark, ODD)).count() >= len(ODD)
    assert DIGESTS[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("f", [line_dedup.line_dedup, substring_dedup.substring_dedup, simhash.near_dedup, langid.language_filter])
def test_stages_keep_columns(spark, f):
    rows = docs(spark, ODD)
    out = f(rows)
    assert out.columns == rows.columns and out.count() <= len(ODD)
    assert f(docs(spark, [])).count() == 0


@pytest.mark.parametrize("m", [topk, substring_dedup, line_dedup])
def test_sql(spark, duck, m):
    same(m.query(spark, SF), duck, m.ORACLE)


# top-k


def brute_top_k(rows, queries, k):
    out = set()
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    for q in queries:
        own = next(v for i, v in whole if i == q)
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q))[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_ties_and_bad_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5]) for _ in range(4)]) for i in range(300)] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(200)]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [1.0, float("nan"), 0.0, 0.0]), (2003, [float("inf")] * 4), (None, [1.0] * 4), (2004, [1.0]), (2100, [9.9])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumnRenamed("x", "x")
    wanted = [i for i, _ in rows if i % 100 == 0]
    found = topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block=3)
    assert {tuple(x) for x in found.collect()} == brute_top_k(rows, wanted, 10) | {(2100, 1, 2004, 10137 * 1024)}
    few = df.where("vec_id < 4")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 3
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("scale", [1.0, 2.0**20, 3.0e19])
def test_top_k_of_large_scores(spark, monkeypatch, scale):
    """Also where scores need all 64 bits, or more than these: the kth scores are found, and few pairs are kept."""
    r = random.Random(7)
    rows = [(i, [r.choice([-1, 1]) * r.random() * scale * 1.2 for _ in range(2)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = set()
    for q in (0, 100, 200, 300):
        score = {i: max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(whole[q], v)))) for i, v in whole.items() if i != q}
        want |= {(q, rank, i, score[i]) for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:10], 1)}
    found = topk.top_k(df, df.where("vec_id % 100 = 0"))
    assert {tuple(x) for x in found.collect()} == want
    ids = np.array([0, 100])
    kth, need = topk.kth_scores(topk.usable(df), ids, np.floor(1024 * np.array([rows[0][1], rows[100][1]])), 10, topk._longest(topk.usable(df)))
    assert kth.tolist() == [min(x[3] for x in want if x[0] == q) for q in ids]


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 1.0]])
    assert topk.products(a, a)[0, 0] == topk.MOST
    b = np.array([[2.0**30, 3.0]])
    assert topk.products(b, b)[0, 0] == (1 << 60) + 9


# SentencePiece

MODEL = open(public_tokenizers.path(pieces.MODEL), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabcdethe.,$éß日한🦄▁<>/s0x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_pieces_like_the_library(text):
    c = pieces.coder(MODEL)
    ids = LIBRARY.encode(text)
    assert c.encode(text) == ids and c.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258)), max_size=10))
def test_decode_any_ids(ids):
    if 0 not in ids:
        assert pieces.coder(MODEL).decode(ids) == LIBRARY.decode(ids)


def test_long_unbroken_text():
    """Two million characters without a place to cut, all of them known to the model: linear time, the library's ids, and nothing remembered."""
    r = random.Random(3)
    c = pieces.PieceCoder(MODEL)
    took = []
    for n in (1_000_000, 2_000_000):
        long = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
        assert c.known.issuperset(long) and len(c.parts(long)) == 1
        start = time.process_time()
        ids = c.encode(long)
        took.append(time.process_time() - start)
        assert ids == LIBRARY.encode(long) and c.decode(ids) == long
    assert took[1] < 20 * SLOW and took[1] < 2.5 * took[0]
    mixed = "".join(r.choices("abcdefghijklmnopqrstuvwxyz漢字é", k=20_000))
    assert c.encode(mixed) == LIBRARY.encode(mixed)
    assert not c.encoded and all(len(k) <= pieces.LONGEST for k in c.both)


def test_pieces_digest_like_the_library(spark):
    """The registered digest of every document and of odd rows."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {}
    for d, t in [*rows.collect(), *((x[0], x[1]) for x in ODD)]:
        ids = LIBRARY.encode(t or "")
        want[d, hashlib.sha256((t or "").encode()).hexdigest()] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())
    both = rows.union(docs(spark, ODD).select("doc_id", "text"))
    texts = {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in both.collect()}
    assert texts == set(want)
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_digest(both).collect()}
    assert found == {(d, *x) for (d, _), x in want.items()}


def test_pieces_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.ids for r in pieces.encode(rows).collect()}
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert all(found[d] == LIBRARY.encode(t) for d, t in texts.items())
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(rows)).collect()} == texts


# packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=25))
def test_plan_is_whole_and_no_worse_than_best_fit(histogram):
    plan = packing.Plan(histogram, 40)
    bins, seen = {}, []
    for n, lo, hi, base, offset in plan.slots:
        for rank in range(lo, hi):
            seen.append((n, rank))
            bins.setdefault(base + rank - lo, []).append((offset, n))
    assert sorted(seen) == sorted((n, k) for n in histogram for k in range(histogram[n]))
    for parts in bins.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 40
    rooms = []
    for n in sorted((n for n in histogram for _ in range(histogram[n])), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(40 - n)
    assert len(bins) == plan.sequences <= len(rooms)


def optimum(sizes, capacity):
    """Fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    for n in range(1, len(sizes) + 1):
        def place(k, rooms):
            if k == len(sizes):
                return True
            return any(rooms[i] >= sizes[k] and place(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :]) for i in range(n) if rooms[i] not in rooms[:i])
        if place(0, [capacity] * n):
            return n
    return 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_is_safe(sizes):
    """What the reduction fixes belongs to some optimum."""
    histogram = {n: sizes.count(n) for n in sizes}
    plan = packing.Plan.__new__(packing.Plan)
    plan.capacity, plan.sequences, plan.slots = 20, 0, []
    plan.left, plan.used, plan.sizes = dict(histogram), dict.fromkeys(histogram, 0), sorted(histogram)
    plan.reduce()
    rest = [n for n, k in plan.left.items() for _ in range(k)]
    assert plan.sequences + optimum(rest, 20) == optimum(sizes, 20)


def test_packed_ids_like_tokenizers(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    packed = packing.pack(rows, with_ids=True)
    found = packed.orderBy("doc_id", "piece").collect()
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {}
    for r in found:
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 1024 and (r.piece == 0 or r.length == 1024)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert got == {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= 1.02 * -(-total // 1024) + 1
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == total


# substring dedup


def brute_substrings(rows):
    first, kept = {}, {}
    for d, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), set()).add(d)
    for d, t in rows:
        w = (t or "").split()
        gone = {k for p in range(len(w) - 49) if min(first[tuple(w[p : p + 50])]) < d for k in range(p, p + 50)}
        kept[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return kept


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_substrings_by_brute_force(spark, letters):
    r = random.Random(letters)
    words = [f"w{k}" for k in range(letters)]
    passages = [[r.choice(words) for _ in range(r.choice([49, 50, 51, 90, 200]))] for _ in range(6)] + [["w1"] * 120]
    rows = []
    for d in range(60):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [r.choice(words) for _ in range(r.randint(0, 70))]
            p = r.choice(passages)
            text += p[r.randint(0, 5) :] if r.random() < 0.5 else p
        rows.append((d * 3 % 61, " ".join(text)))
    found = by_id(substring_dedup.substring_dedup(docs(spark, rows)))
    digest = by_id(substring_dedup.substring_dedup_digest(docs(spark, rows)))
    for d, (n, gone, kept) in brute_substrings(rows).items():
        assert (digest[d].n_words, digest[d].n_removed, " ".join(found[d].text.split())) == (n, gone, kept)


def test_words_that_polynomial_hashes_confuse(spark):
    """A Thue-Morse word and its complement collide under any polynomial modulo 2^64; nothing repeats here."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    run = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join([*run, x, *run])), (2, " ".join([*run, y, *run])), (3, " ".join([*run, y, *run[:-1], "other"]))]
    digest = by_id(substring_dedup.substring_dedup_digest(docs(spark, rows)))
    assert {d: (r.n_words, r.n_removed) for d, r in digest.items()} == {1: (61, 0), 2: (61, 0), 3: (61, 60)}


def test_repeated_rows_and_clashing_columns(spark):
    """Rows equal in doc_id and text are judged once; names that the operators use may stand in the table."""
    passage = " ".join(f"w{k}" for k in range(70))
    line = "a line of ten characters or more"
    rows = [(1, passage + "\n" + line)] * 30 + [(2, f"x {passage}\n{line}")] * 30 + [(2, passage[:-4] + " y")] + [(None, passage)] * 2
    table = docs(spark, rows)
    for name in ("repeat_spans", "repeat_doc", "repeat_chk", "lost_keys_id", "lost_doc", "kept_id", "used_id", "lang_bits", "lang_pred"):
        table = table.withColumn(name, F.lit(7))
    out = substring_dedup.substring_dedup(table)
    assert out.columns == table.columns and sorted((r.doc_id or 0, " ".join(r.text.split()), r.repeat_chk) for r in out.collect()) == sorted(
        [(0, passage, 7)] * 2 + [(1, f"{passage} {line}", 7)] * 30 + [(2, "x", 7)] * 30 + [(2, "y", 7)]
    )
    out = line_dedup.line_dedup(table)
    assert out.columns == table.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, passage)] * 2 + [(1, f"{passage}\n{line}")] * 30 + [(2, f"x {passage}")] * 30 + [(2, passage[:-4] + " y")])
    assert simhash.near_dedup(table).columns == table.columns and langid.language_filter(table).columns == table.columns


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(5)
    for letters in (2, 4, 30):
        passage = r.integers(0, letters, 120)
        seen = {}
        for _ in range(40):
            doc = np.concatenate([r.integers(0, letters, r.integers(0, 60)), passage[r.integers(0, 30) :], r.integers(0, letters, r.integers(0, 60))])
            hashes = substring_dedup.mix(doc.astype(np.uint64) + np.uint64(7))
            for p, n, name in zip(*substring_dedup.anchors(hashes, np.array([len(doc)])), strict=True):
                for k in range(p, p + n):
                    assert seen.setdefault(tuple(doc[k : k + 50]), name) == name


# line dedup


def test_lines(spark):
    rows = [(5, "A shared line here\nown five line\nshort"), (2, "  a SHARED line here \t\nshort\n"), (9, "a shared line here\na shared line here\nown nine line"), (None, "a shared line here"), (7, "ééééééééé\nÉéééééééééé"), (8, "ééééééééé\nÉéééééééééé"), (6, None)]
    for batches in (1, 3, 5):
        found = by_id(line_dedup.line_dedup(docs(spark, rows), batches))
        assert found[2].text == rows[1][1] and found[5].text == "own five line\nshort" and found[9].text == "own nine line"
        assert found[None].text == "a shared line here" and found[7].text == rows[4][1] and found[8].text == "ééééééééé" and found[6].text is None


def test_runs_are_compacted(spark):
    store = line_dedup.LineRuns(Scratch(spark, "runs"), 2)
    for k in range(5):
        store.add(spark.createDataFrame([(k, bytes([k] * 16)), (k, bytes([99] * 16))], "doc_id long, key binary")).count()
        store.compact()
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert sum(r.count() for level in store.levels for r in level) == 6


# SimHash


def brute_components(pairs, least=2):
    fps = [int(x) & (1 << 64) - 1 for _, x in pairs]
    label = {k: k for k in range(len(pairs))}
    changed = True
    while changed:
        changed = False
        for a in range(len(pairs)):
            for b in range(len(pairs)):
                if label[a] != label[b] and (fps[a] ^ fps[b]).bit_count() <= least:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    low = {}
    for k, (d, _) in enumerate(pairs):
        low[label[k]] = min(low.get(label[k], d), d)
    return {d: low[label[k]] for k, (d, _) in enumerate(pairs)}


@pytest.mark.parametrize("cell", [1, 1024])
@pytest.mark.parametrize("sampled", [64, 1])
def test_links_by_brute_force(spark, monkeypatch, cell, sampled):
    """With cells of one fingerprint all go through the exact second grid, by way of the first one or, if the sample has all, at once."""
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(cell)
    base, fps = [r.getrandbits(64) for _ in range(6)], []
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
    rows = [(k * 7 % 151, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(fps)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d: d.select("doc_id", "fp"))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"))
    assert {x.doc_id: x.component_id for x in found.collect()} == brute_components(rows)


def test_fingerprint_like_spark(spark):
    """Words, shingles and hashes by Spark's own functions."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    words = F.filter(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+"), lambda w: w != "")
    parts = F.when(F.size("w") < 3, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    h = rows.select("doc_id", words.alias("w")).select("doc_id", F.transform(parts, lambda s: F.xxhash64(s)).alias("h"))
    want = {r.doc_id: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h)) for r in h.collect()}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(rows).collect()} == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t\n") == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 3), (10, 11), (12, 11), (12, 10), (7, 7)] + [(k, k + 1) for k in range(100, 140)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc"))
    assert {(r.u, r.v) for r in found.collect()} == {(2, 1), (3, 1), (4, 1), (11, 10), (12, 10)} | {(k, 100) for k in range(101, 141)}


def test_fingerprints_as_registered(spark):
    """16 hex digits and components of every document and of odd rows, against all pairs in Python."""
    found = simhash.query(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in rows}
    low = brute_components(list(prints.items()))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(d, f"{p:016x}", low[d]) for d, p in prints.items()}
    odd = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs(spark, ODD)).collect()}
    known = [(d, simhash.fingerprint((t or "").encode())) for d, t in ODD if d is not None]
    low = brute_components(list(dict(known).items()))
    assert {x for x in odd if x[0] is not None} == {(d, p, low[d]) for d, p in known}


def test_near_dedup_keeps_one(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the farm " * 5
    out = simhash.near_dedup(docs(spark, [(4, text), (2, text), (9, text.upper()), (1, "another text"), (None, text)]))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]


# media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_media_round_trip(texts):
    files = media.write_all(texts)
    samples, sizes, lengths = media.read_all(files)
    assert samples.tobytes() == b"".join(map(media.payload, texts)) and lengths == [len(t) for t in texts]
    assert sizes.tolist() == [max(1, -(-len(t) // 192)) for t in texts]


def test_media_digest_by_hand(spark):
    """The registered digest against payloads padded here; the stored bytes give them back."""
    rows = [*ODD, (8, "a" * 192), (9, "b" * 193), (10, "")]
    made = media.media_digest(docs(spark, rows)).collect()
    assert len(made) == len(rows)
    by_text = {}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        by_text[d, len(raw)] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), media.write_all([raw])[0])
    for r in made:
        n, sha, tail, stored = by_text[r.doc_id, r.n_bytes]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (n, sha, tail, len(stored), hashlib.sha256(stored).hexdigest())
    same_text = [(r.media_sha256, r.media_bytes, r.feature) for r in made if r.doc_id in (1, 3, 10)]
    assert len(set(same_text)) == 1


def test_clips(spark):
    text = "a" * 192 * 12 + "\x7f" * 192 * 12
    found = media.clips(media.files(docs(spark, [(1, text), (2, None)]))).orderBy("doc_id", "clip").collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 12, 0.0, 0.48), (1, 1, 12, 24, 0.48, 0.96), (2, 0, 0, 1, 0.0, 0.04)]
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")


# token counts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '’sltre1\n\t.,é日 ", max_size=500), st.lists(st.tuples(st.integers(-3, 520), st.integers(-3, 520), st.text(alphabet="a '\n1lre", max_size=90)), max_size=6))
def test_edits_like_counting_anew(text, edits):
    counter = token_counts.Counter(open(public_tokenizers.path(packing.RANKS), "rb").read())
    parts = token_counts.split(text)
    tree = token_counts.TokenTree(parts, [counter(p) for p in parts], counter)
    for start, stop, new in edits:
        a = min(max(start, 0), len(text))
        text = text[:a] + new + text[min(max(stop, a), len(text)) :]
        tree.edit(start, stop, new)
        assert tree.parts() == token_counts.split(text) and tree.count == sum(map(counter, tree.parts()))


def test_odd_rows_have_their_tokens(spark):
    """Null, empty, repeated and long texts: packed pieces and counted trees against the library."""
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(d, t) for d, t in ODD if d != 5] + [(5, "x" * 3000)]
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = packing.pack(docs(spark, rows)).collect()
    pieces_of = lambda d: sorted((r.piece, r.start, r.length) for r in got if r.doc_id == d)
    for d, t in rows:
        cuts = packing.cut(size(t) + 1, packing.CAPACITY)
        assert pieces_of(d) == sorted([(k, a, n) for k, (a, n) in enumerate(cuts)] * sum(x == d for x, _ in rows))
    counted = token_counts.apply_edits(token_counts.redactions(token_counts.trees(docs(spark, rows)))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == sorted((d or 0, size(t)) for d, t in rows)
    assert all(r.n_tokens_edited == size(r.text) for r in counted)


def test_edits_touch_little(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    out = token_counts.apply_edits(token_counts.redactions(token_counts.trees(rows))).collect()
    enc = packing.encoding(open(public_tokenizers.path(packing.RANKS), "rb").read())
    assert all(r.n_tokens_edited == len(enc.encode_ordinary(r.text)) == sum(r.tokens) for r in out)
    assert sum(r.n_reencoded for r in out) < 0.2 * sum(r.n_pretokens for r in out)


# language and quality


def test_suffix_automaton():
    a = langid.SuffixAutomaton(["banana", "bandana"])
    parts = {w[i:j] for w in ("banana", "bandana") for i in range(7) for j in range(i + 1, len(w) + 1)}
    for s in parts | {"nab", "andb", "xx", "bananaband"}:
        k = n = 0
        while k < len(s):
            size = next((m for m in range(len(s) - k, 0, -1) if s[k : k + m] in parts), 1)
            k, n = k + size, n + 1
        assert a.phrases(s) == n


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.query(spark, "/root/testdata/sf0.01").join(rows.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() >= 0.97
    p = langid.Parser(langid.learn(rows))
    assert [x[:2] for x in p.predict([None, "", " 12 !?", "² ½", "Ⅻ"])] == [("und", 0.0)] * 5
    assert langid.Parser(langid.Models({})).predict(["words"])[0][0] == "und"


def brute_phrases(text, learned):
    at = n = 0
    while at < len(text):
        size = next((k for k in range(len(text) - at, 1, -1) if any(text[at : at + k] in x for x in learned)), 1)
        at, n = at + size, n + 1
    return n


def plain(text):
    return " " + "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()) + " "


@pytest.mark.parametrize("segment", [7, 512])
def test_language_by_brute_force(monkeypatch, segment):
    """Phrase counts and predictions against longest matches by search, across segments, also of learned and repeated texts."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(segment)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(40)] for lang, letters in (("a", "abcde"), ("b", "bcdef"), ("c", "éxyz漢"))}
    learned = {lang: [" ".join(rng.choices(w, k=60)) for _ in range(3)] for lang, w in words.items()}
    texts = [" ".join(rng.choices(w, k=rng.randint(1, 40))) for w in words.values() for _ in range(6)] + [learned["a"][0], learned["c"][1] * 2, "q" * 40, "Ab-12 CD", "abcde" * 10]
    p = langid.Parser(langid.Models(learned))
    want = []
    for t in texts:
        x = " ".join(plain(t).split())
        x = f" {x} "
        sizes = {lang: [" " + " ".join(plain(y).split()) + " " for y in learned[lang]] for lang in learned}
        want.append([brute_phrases(x, sizes[lang]) for lang in sorted(sizes)])
    assert p.counts([langid.normal(t)[0] for t in texts]).tolist() == want
    bits = np.array(want) * np.array(p.models.bits)
    assert [x[0] for x in p.predict(texts)] == ["abc"[k] for k in bits.argmin(axis=1)]


def test_many_languages_and_long_words(spark):
    """120 languages of 50-letter words are all learned, each by its own text."""
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(120):
        alphabet = [chr(0x4E00 + 20 * k + j) for j in range(12)]
        words = ["".join(rng.choices(alphabet, k=50)) for _ in range(4)]
        rows += [(2 * k, " ".join(words), f"l{k:03}"), (2 * k + 1, " ".join(reversed(words)), None)]
        want |= {2 * k: f"l{k:03}", 2 * k + 1: f"l{k:03}"}
    found = langid.predictions(docs(spark, rows), langid.learn(docs(spark, rows), held_fold=None))
    assert {r.doc_id: r.lang_pred for r in found.collect()} == want


def test_language_of_odd_rows(spark):
    learned = [(k, "the words of one tongue are here", "en") for k in range(100, 110)] + [(k, "les mots de notre langue sont ici", "fr") for k in range(110, 120)] + [(20, None, "fr"), (None, "words", "en"), (21, "unlabelled", None)]
    rows = docs(spark, [*ODD, *learned, (30, "ici notre langue")])
    found = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predictions(rows, langid.learn(rows)).collect()}
    assert [found[k] for k in (1, 2, 3, 20)] == [("und", 0.0)] * 4 and found[30][0] == "fr" and found[5][0] in ("en", "fr") and 0 < found[30][1] <= 1


def test_language_filter_rejects(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90001, "漢字仮名交じり文漢字仮名", None, "s", 9), (90002, "12 34", None, "s", 5), (90003, None, "en", "s", 0)], rows.schema)
    out = langid.language_filter(rows.union(more))
    assert out.columns == rows.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in rows.collect()}


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (found.quality == found.predicted).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_quality_by_brute_force(spark):
    """Scores against averaged vectors and softmax computed anew; copies of labelled rows teach once."""
    rng = random.Random(2)
    good, bad = "fine clean prose".split(), "spam spam buy".split()
    rows = [(k, " ".join(rng.choices(good if k % 2 else bad, k=12))) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    weights = quality.learn(docs(spark, rows), labels)
    again = quality.learn(docs(spark, rows * 3), labels.union(labels))
    assert (weights == again).all()
    found = {r.doc_id: r.score for r in quality.scores(docs(spark, rows + [(100, None), (101, "")]), weights).collect()}
    for d, t in rows + [(100, ""), (101, "")]:
        ids = [quality.EVERY] + [i for w in t.encode().split() for i in quality.features(w)]
        words = t.split()
        ids += [quality.AGAIN for a, b in zip(words, words[1:]) if a == b]
        assert abs(found[d] - 1 / (1 + np.exp(-np.mean(weights[ids])))) < 1e-9
    assert np.mean([(found[k] >= 0.5) == (k % 2 == 1) for k in range(60)]) > 0.95


def test_quality_without_labels(spark):
    rows, labels = docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.learn(rows, labels.where("false")).sum() == 0
    assert {r.score for r in quality.scores(rows, np.zeros(quality.BUCKETS + 2)).collect()} == {0.5}


def test_folds_like_zlib(spark):
    ids = [0, 1, 7, 123456789, -5]
    found = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r[0] for r in found.select(langid.folds(found)).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in ids]
