"""Spelling variants, vector codes and WARC archives against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from fixtures import CLASHING, no_documents, odd_documents
from pyspark.sql import functions as F

from segmenta.llm import codes, spelling, warc
from segmenta.session import checkpoint_dir

# --- spelling ---------------------------------------------------------------------------------------------------------

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(words):
    near = defaultdict(list)
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return Counter((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def spelled(seed, docs=150, alphabet="abéÿ×"):
    """Few stems, many misspellings, counts that differ by much."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(7, 13))) for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.expovariate(0.5)), 11)]
            if rng.random() < 0.25:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice(alphabet) + (w[at] if kind == 1 else "")) + w[at + 1:]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "1", "ā"]).join(words)))
    return rows


@pytest.mark.parametrize("tile,block", [(1024, 32), (3, 2)])
def test_spelling_variants(spark, monkeypatch, tile, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = spelled(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    words = plain_words(rows)
    assert {(r.word, r.n) for r in spelling.vocabulary(docs).collect()} == set(words.items())
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(table, tile=tile).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for a, b in combinations(words, 2) if one_edit(a, b) for p in ((a, b), (b, a))}
    if tile > 3:
        got = spelling.variants(docs).collect()
        assert Counter(tuple(r[c] for c in VARIANT) for r in got) == plain_variants(words)


def test_forms_are_followed_to_the_last(spark):
    words = {"word" + "a" * i + "b" * (9 - i): 3 * 11 ** i for i in range(10)} | {"alonealone": 5}
    got = spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert Counter(tuple(r[c] for c in VARIANT) for r in got) == plain_variants(words)
    assert {r.root for r in got} == {"wordaaaaaaaaa", "alonealone"}


def test_hot_stem_is_halved_until_it_is_bounded(spark):
    # a third of all words share everything but one short stretch, and some words are very long
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choice("abcd") for _ in range(5)) + "suffix": 2 + i for i in range(900)}
    words |= {"".join(rng.choice("xyz") for _ in range(9)): 5 for _ in range(1500)}
    words |= {"l" * 3000: 9, "l" * 2999: 4, "l" * 1500 + "m" + "l" * 1499: 3, "日本語の単語です": 3, "日本語の単語だす": 40}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [(r.word, r.near) for r in spelling.near_pairs(table, tile=20).collect()]
    want = set()
    for w in words:  # every word one edit away, by deletion
        for i in range(len(w)) if len(w) < 50 else ():
            want |= {(w, x) for x in (w[:i] + w[i + 1:],) if x in words}
    gone = defaultdict(set)
    for w in words:
        for i in range(len(w)) if len(w) < 50 else ():
            gone[w[:i], w[i + 1:]].add(w)
    for group in gone.values():
        want |= {(a, b) for a in group for b in group if a != b}
    want |= {(b, a) for a, b in want}
    a, b, c = "l" * 3000, "l" * 2999, "l" * 1500 + "m" + "l" * 1499
    want |= {(a, b), (b, a), (a, c), (c, a), (b, c), (c, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_spelling_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(77, "l" * 40 + " " + "l" * 40), (78, "l" * 41 + " " + "l" * 41), (None, "nobody " * 30)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r[c] for c in VARIANT) for r in got) == plain_variants(plain_words(rows))
    assert spelling.variants(no_documents(spark)).count() == 0


# --- vector codes -----------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return Counter()
    d = len(kept[0][2])
    same = [r for r in kept if len(r[2]) == d]
    cuts = [d * p // parts for p in range(parts + 1)]
    first = [r for r in kept[:entries] if len(r[2]) == d]
    books = [[r[2][a:b] for r in first] for a, b in zip(cuts, cuts[1:])]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    def assign():
        return [[min(range(len(books[p])), key=lambda e: (gap(v[cuts[p]:cuts[p + 1]], books[p][e]), e)) for p in range(parts)] for _, _, v in same]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[cuts[p]:cuts[p + 1]] for (_, _, v), c in zip(same, got) if c[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = __import__("hashlib").sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = [(i, lab, "".join(f"{x:02x}" for x in c), sum(gap(v[cuts[p]:cuts[p + 1]], books[p][c[p]]) for p in range(parts))) for (i, lab, v), c in zip(same, assign())]
    out += [(i, lab, None, None) for i, lab, v in kept if len(v) != d]
    long = lambda x: x if x is None or x < 1 << 63 else None
    sums = defaultdict(lambda: None)
    for _, lab, _, e in out:
        if long(e) is not None:
            sums[lab] = (sums[lab] or 0) + e
    return Counter((i, c, long(e), long(sums[lab]), sha) for i, lab, c, e in out)


CODE = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, d=16, seed=0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.4) for _ in range(d)] for _ in range(7)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        v = [float(np.float32(x + rng.gauss(0, 0.05))) for x in c] if i % 3 else [float(np.float32(x)) for x in centers[0]]  # a third is one vector
        rows.append((3 * i + 1, v, rng.choice([None, 0, 1, 2])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,leaf", [(8192, 64), (60, 5)])
def test_vector_codes(spark, monkeypatch, chunk, leaf):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    monkeypatch.setattr(codes, "LEAF", leaf)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    assert Counter(tuple(r[c] for c in CODE) for r in codes.compress(df).collect()) == plain_codes(rows)


def test_vector_codes_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(codes, "LEAF", 4)
    rows = vectors(60, 10)  # 8 does not divide 10
    rows += [(500, None, 1), (501, [None] * 10, 1), (502, [float("nan")] * 10, 1), (503, [float("inf")] * 10, 1), (504, [0.5] * 9, 2), (505, [], None),
             (7, [0.25] * 10, 3), (7, [0.25] * 10, 3), (7, [0.5] * 10, None), (None, [0.125] * 10, None)]
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(tuple(r[c] for c in CODE) for r in got) == plain_codes(rows)
    few = rows[:5]
    assert Counter(tuple(r[c] for c in CODE) for r in codes.compress(spark.createDataFrame(few, VECTORS)).collect()) == plain_codes(few)
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    none = spark.createDataFrame([(1, None, 1)], VECTORS)
    assert codes.compress(none).count() == 0


def test_vector_codes_are_exact_at_any_size(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.choice([-1, 1]) * 10.0 ** rng.randrange(3, 12))) for _ in range(8)], i % 2) for i in range(40)]
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert Counter(tuple(r[c] for c in CODE) for r in got) == plain_codes(rows)
    assert any(r.error is None for r in got)


def test_trees_own_balls_and_leave_out_entries():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 30, (500, 8)) for c in rng.normal(0, 3000, (6, 8))]).astype(np.int64)
    tree = codes.Tree(x)
    entries = x[::200]
    owned, left = tree.shares(entries)
    assert sum(int(tree.count[b].sum()) for b, _ in owned) + sum(int(tree.count[b].sum()) for b, _ in left) == len(x)
    assert sum(int(tree.count[b].sum()) for b, _ in owned) > 0
    assert sum(int(m.sum()) for _, m in left) < sum(m.size for _, m in left)
    gaps = ((x[:, None] - entries[None]) ** 2).sum(2)
    code, far = tree.codes(entries)
    assert (code == gaps.argmin(1)).all() and (far == gaps.min(1)).all()
    sums, counts = tree.totals(entries)
    assert (counts == np.bincount(code, minlength=len(entries))).all() and all((sums[e] == x[code == e].sum(0)).all() for e in range(len(entries)))


def test_decoded_vectors_have_the_error_of_their_codes(spark):
    rows = vectors(100)
    df = spark.createDataFrame(rows, VECTORS)
    books, trees, _ = codes.learn(df)
    whole = {i: codes.scaled(np.array(v)) for i, v, _ in rows}
    for r in codes.encode(trees, books).withColumn("v", codes.decode(F.col("code"), books)).collect():
        assert ((whole[r.vec_id] - np.array(r.v) * 4096) ** 2).sum() == r.error


# --- WARC -------------------------------------------------------------------------------------------------------------

DIGEST = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def odd_pages(spark):
    mark = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nafter"
    rows = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"), (1, "http://a/1", None),
            (2, "http://a/2", ""), (2, "http://a/2", ""), (4, "http://a/ü\r\nX: y", mark), (6, "u", "é漢😀" * 9000), (7, "u", "é漢😀" * 9000), (8, "u", mark * 3000),
            (10, "u", "\r\n\r\n"), (11, "u", "0\r\n\r\n"), (12, None, "x" * 200_000), (None, None, "nobody"), (None, None, "nobody"), (13, "u", "\r\nWARC/1.0"), (14, "u", "\r")]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i % 40}</p>" * (i % 40 * 50)) for i in range(120)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def digests(df):
    return Counter(tuple(r[c] for c in DIGEST) for r in df.select(*DIGEST).collect())


def folder(spark):
    return f"{checkpoint_dir(spark)}/warc-{random.getrandbits(60):x}"


@pytest.mark.parametrize("params", [{}, {"segment_bytes": 700, "chunk_bytes": 64, "compression": "none"}])
def test_archives_read_back(spark, params):
    pages, path = odd_pages(spark), folder(spark)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many tasks a file
    try:
        got = digests(warc.write_and_read(pages.repartition(2), path, **params))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url", "html").toArrow())
    assert got == Counter(con.execute(f"SELECT {', '.join(DIGEST)} FROM ({warc.SQL})").fetchall())
    texts = {(r.page_id, r.payload.decode()) for r in warc.resolved(spark, path).collect()}
    assert texts == {(r.page_id, r.html or "") for r in pages.collect()}
    kinds = Counter(r.record_type for r in warc.read_records(spark, path).collect())
    assert kinds["response"] == pages.select(F.coalesce("html", F.lit(""))).distinct().count() and kinds["continuation"] > 5


def test_small_payloads_are_not_revisited(spark):
    pages = odd_pages(spark)
    got = warc.write_and_read(pages, folder(spark), min_revisit_bytes=12).collect()
    assert {r.record_type for r in got if r.payload_bytes < 12} == {"response"} and any(r.record_type == "revisit" for r in got)
    assert len(got) == pages.count()


def test_empty_archive(spark):
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string"), folder(spark)).count() == 0


def record(kind, rid, block, *fields):
    return b"WARC/1.0\r\n" + "".join(f"{f}\r\n" for f in (f"WARC-Type: {kind}", f"warc-record-id: <{rid}>", *fields, f"Content-Length: {len(block)}")).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(payload):
    return warc.HTTP_HEAD + warc.chunked(payload, 10)


def test_foreign_archives(spark, tmp_path):
    """Segments in any order and in several files, broken ones, folded fields, plain bodies, and the separator inside a block."""
    block = http(b"0123456789" * 20)
    cut = [block[:50], block[50:111], block[111:]]
    def segments(rid, total, numbers=(1, 2, 3)):
        out = [record("response", rid, cut[0], "WARC-Segment-Number: 1", "Page-Id: 1")]
        out += [record("continuation", f"{rid}-{n}", cut[n - 1], f"WARC-Segment-Origin-ID: <{rid}>", f"WARC-Segment-Number: {n}",
                       *([f"WARC-Segment-Total-Length: {total}"] if n == 3 else [])) for n in numbers if n > 1]
        return out[0 if 1 in numbers else 1:]
    good, wrong, short, headless = segments("good", len(block)), segments("wrong", len(block) + 1), segments("short", len(block), (1, 3)), segments("none", len(block), (2, 3))
    one = [good[2], wrong[0], short[0], record("warcinfo", "info", b"software: x"), good[1], good[1]]
    two = [wrong[1], good[0], short[1], wrong[2], *headless, record("response", "plain", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n"),
           record("response", "broken", warc.HTTP_HEAD + b"5\r\nab\r\n0\r\n\r\n"), record("revisit", "again", b"", "WARC-Refers-To:\r\n <good>"),
           record("revisit", "lost", b"", "WARC-Refers-To: <nowhere>")]
    inside = [record("response", "inside", b"HTTP/1.0 200 OK\r\n\r\nx\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc"), record("response", "behind", http(b"b"))]
    for name, some in (("a", one), ("b", two), ("c", inside)):
        (tmp_path / f"{name}.warc").write_bytes(b"".join(some))
    got = {r.record_id: (r.payload and bytes(r.payload), r.problem) for r in warc.resolved(spark, str(tmp_path)).collect()}
    assert got["good"] == (b"0123456789" * 20, None) and got["again"] == got["good"]
    assert got["wrong"] == (None, "segments: total length") and got["short"] == (None, "segments: one is missing")
    assert got["plain"] == (b"body\r\n\r\n", None) and got["broken"][1].startswith("framing") and got["lost"] == (None, "refers to no record")
    assert got["inside"][0].startswith(b"x\r\nWARC/1.0") and got["inside"][0].endswith(b"abc") and got["behind"] == (b"b", None)
    assert len(got) == 10 and sum(p == "segments: one is missing" for _, p in got.values()) == 2


def test_chunks():
    for payload in (b"", b"a", b"\r\nWARC/1." * 50, b"WARC/1." * 9, bytes(range(256)) * 9):
        for size in (1, 7, 1000):
            body = warc.chunked(payload, size)
            assert warc.unchunked(body) == payload and b"\r\nWARC/1." not in body
    for bad in (b"", b"5\r\nab", b"zz\r\n", b"1\r\na"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_base32(spark):
    import base64
    import hashlib

    df = spark.range(50).select(F.col("id").cast("string").alias("t")).select("t", warc.base32_sha1(F.sha1("t")).alias("b"))
    assert all(r.b == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in df.collect())
