import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import invented, near_components, near_documents, no_documents, odd_documents, shingles

from segmenta.llm import neardup, substrings


def brute_bytes(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p:p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                cover[p:p + length] = True
        spans = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(r) else 0
        kept = bytes(b for b, c in zip(r, cover) if not c)
        out.append((len(r), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def mosaic():
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i in range(150):
        s = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 300)
            s += b[a:a + rng.randint(5, 120)] + rng.choice(["", "x", "yz", "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))])
        rows.append((i, s))
    return rows + [(1000, None), (1001, ""), (1002, "a" * 200), (1003, "ab" * 80), (1003, "ab" * 90), (5, rows[5][1]), (None, base[0]), (None, base[0])]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2000])
def test_repeated_bytes(spark, shard_bytes):
    rows = mosaic()
    got = Counter(tuple(r) for r in substrings.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 40, 13, shard_bytes).collect())
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute_bytes([t for _, t in rows], 40)))


def test_repeated_bytes_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in substrings.repeated_bytes(docs).collect())
    assert got == Counter((i, *b) for (i, _), b in zip(rows, brute_bytes([t for _, t in rows], 400)))
    assert substrings.repeated_bytes(no_documents(spark)).count() == 0
    left = substrings.without_repeats(docs, 40, 13)
    assert left.columns == docs.columns and left.count() == docs.count()


def test_passages_of_over_fifty_words(spark):
    """Passages of 51 to 90 words that repeat across documents, among clean ones that share shorter lines: byte for byte as by
    brute force, whole passages of 400 bytes and more, and nothing of those below, which the length leaves alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 90))) for _ in range(40)]
    lines = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = []
    for i in range(160):
        body = [word() for _ in range(rng.randint(20, 300))]
        body.insert(rng.randrange(len(body)), passages[i // 2] if i < 80 else rng.choice(lines))
        rows.append((i, " ".join(body)))
    got = {r.doc_id: r for r in substrings.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_bytes([t for _, t in rows], 400)
    assert all((got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w for (i, _), w in zip(rows, want))
    long = {i for i in range(80) if len(passages[i // 2]) >= 400}
    assert 20 < len(long) < 70 and {i for i, r in got.items() if r.n_removed} >= long and all(got[i].n_removed >= len(passages[i // 2]) for i in long)
    assert all(got[i].n_removed == 0 for i in range(80, 160))


def test_suffix_arrays():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 60))) for _ in range(12)] + [b"aaaa", b"aaaa"]
    text = np.frombuffer(b"".join(texts), np.uint8)
    size = [len(t) for t in texts]
    ends = np.repeat(np.cumsum(size), size)
    order = substrings.suffix_array(text, ends)
    suffix = [bytes(text[i:ends[i]]) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffix[i], i))
    common = [0] + [next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b])) if x != y), min(len(suffix[a]), len(suffix[b])))
                    for a, b in zip(order, order[1:])]
    assert substrings.common_prefixes(text, ends, order).tolist() == common


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    docs = near_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = near_components(rows, words)
    got = neardup.near_duplicates(docs, words=words).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    text = dict(rows)
    assert all(r.n_shingles == len(shingles(text[r.doc_id], words)) and r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.one_of_each(docs, words=words)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_duplicates_in_chunks(spark, monkeypatch):
    """Buckets and pivots with more members than a chunk."""
    monkeypatch.setattr(neardup, "CHUNK", 3)
    docs = near_documents(spark)
    want = near_components([(r.doc_id, r.text) for r in docs.collect()], 2)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=2).collect()} == want


def test_near_duplicates_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = neardup.near_duplicates(docs, words=2).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[1, 8] == by[6, 8] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 0] == 4 and by[None, 3] is None
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    assert neardup.one_of_each(docs).columns == docs.columns


def test_two_texts_of_one_doc_id(spark):
    """Each text of a doc_id is linked by itself alone, a text without a doc_id links too, and each group keeps one."""
    a, b, c, chain = (invented(i, 50 + 10 * i, 5000) for i in (1, 2, 3, 4))
    w, other = chain.split(), invented(5, 6, 5000).split()
    left, right = " ".join(other + w[6:]), " ".join(w[:-6] + other[::-1] + ["end"])  # near to chain, not to each other
    rows = [(7, a), (7, b), (20, a + " more"), (21, b + " more"), (7, None), (8, c), (8, c), (8, c + " x"), (30, left), (None, chain), (31, right), (None, "alone here")]
    want = near_components([(i, t) for i, (_, t) in enumerate(rows)], 2)
    assert [want[i] for i in range(12)] == [0, 1, 0, 1, 4, 5, 5, 5, 8, 8, 8, 11] and near_components([rows[8], rows[10]], 2)[31] == 31
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, words=2).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == sorted((i or 0, len(shingles(t, 2))) for i, t in rows)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    named = {(want[k], by[i, len(shingles(t, 2))]) for k, (i, t) in enumerate(rows) if i is not None}
    assert len(named) == len({x for x, _ in named}) == len({y for _, y in named}) == 5 and {8, 30, 7} <= {y for _, y in named}
    kept = Counter((r.doc_id, r.text) for r in neardup.one_of_each(docs, words=2).collect())
    assert kept - Counter([(8, c), (8, c + " x")]) == Counter([(7, a), (7, b), (7, None), (30, left), (None, chain), (None, "alone here")]) and kept.total() == 7


def test_sequential_bounds():
    """A pair at the threshold is hardly ever dropped, one far below nearly always."""
    rng = np.random.default_rng(1)
    n = neardup.BANDS * neardup.ROWS

    def pairs(similarity):
        a = rng.integers(0, 256, (4000, n), np.uint8)
        return a, np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape, np.uint8))

    assert len(neardup.may_reach(*pairs(0.8), 0.8, 1e-6)) >= 3999
    assert len(neardup.may_reach(*pairs(0.4), 0.8, 1e-6)) == 0
    least = [neardup.least_matches(0.8, 1e-6, m) for m in (40, 80, 120, 160, 200)]
    assert least == sorted(least) and neardup.least_matches(0.8, 1e-3, 200) > least[-1]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.id: r.comp for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
