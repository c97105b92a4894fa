"""Small corpora and brute-force versions for the tests."""

import random
import re
import string

#: Names that the operators use for columns of their own.
CLASHING = {"score": 1.5, "n": 2, "g": "g", "x": "x", "part": 3, "k": 4, "id": 5, "comp": 6, "perm": "p", "found": True, "text_key": 7, "runs": "r",
            "positions": "q", "host": "h", "roles": "o", "weight": 0.1}


def odd_documents(spark, extra=True):
    """NULLs in any column, empty and very long texts, repeated rows, one doc_id with two texts, columns with clashing names."""
    long_text = " ".join(f"w{i % 997}x{i % 89}" for i in range(60_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", None),
            (5, long_text, "en", "a"), (6, "the quick brown fox jumps over the lazy dog", "en", "b"), (6, "the quick brown fox jumps over the lazy dog", "en", "b"),
            (7, "one text", "fr", "c"), (7, "another text", "fr", "c"), (None, "nobody owns this text", None, None), (8, "!!! ??? ...", "es", "b"),
            (9, "Ünïcödé ẞtraße 漢字 emoji 😀 end", "de", "c"), (10, "word", "en", "a"), (11, "\x00\x01 nul \x7f", "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        docs = docs.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
    return docs


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def invented(seed: int, words: int, vocabulary: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(f"{'aeiou'[w % 5]}{'bcdfg'[w // 5 % 5]}{w}" for w in (rng.randrange(vocabulary) for _ in range(words)))


def near_documents(spark, groups=12, copies=6, words=80):
    """Groups of texts with single words changed, some exact copies, unrelated texts, and a chain of slow drift."""
    rng, rows = random.Random(5), []
    for g in range(groups):
        base = invented(g, words, 5000).split()
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randrange(5) if c else 0):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w))
        rows.append(" ".join(base).upper())
    drift = invented(999, words, 5000).split()
    for i in range(10):
        for j in range(3):
            drift[(3 * i + j) * 2 % len(drift)] = f"drift{i}{j}"
        rows.append(" ".join(drift))
    rows += [invented(500 + i, 40, 5000) for i in range(20)] + ["alone", "alone", "two words", None, ""]
    rng.shuffle(rows)
    return spark.createDataFrame([(3 * i + 7, t) for i, t in enumerate(rows)], "doc_id long, text string")


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows, k, percent=80):
    """doc_id -> smallest doc_id reachable."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}
