import hashlib
import re
import string
from collections import Counter

import duckdb
import pytest
from fixtures import invented, no_documents, odd_documents
from pyspark.sql import functions as F

from segmenta.llm import decontaminate, mixing, pii

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def in_duckdb(sql, names, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(got.description)}
    return Counter(tuple(r[at[n]] for n in names) for r in got.fetchall())


# --- benchmark decontamination --------------------------------------------------------------------------------------

DIGEST = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, met = words(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    met |= windows[tuple(w[i:i + m])]
        out.append((doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def benchmark_fixture(spark):
    items = [(1, invented(1, 30)), (2, invented(2, 12).upper()), (3, "Short item of five-words here"), (4, None), (5, "!!"), (6, invented(1, 30)), (10, "alone"),
             (11, "seven words are in this item now")]
    docs = [(1, invented(3, 20) + " " + invented(1, 30) + " " + invented(4, 9)), (2, ", ".join(invented(1, 30).split()[3:13])), (3, " ".join(invented(1, 30).split()[3:12])),
            (4, "x short ITEM of five;words HERE y short item of five words"), (5, None), (6, ""), (7, "alone"), (8, "Alone again alone"), (9, invented(2, 12)[1:]),
            (10, "seven words are in this item now"), (11, "q seven words are in this item"), (12, " ".join([invented(2, 12)] * 3))]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)  # 0: joined by a shuffle
    docs, items, d, b = benchmark_fixture(spark)
    got = rows_of(decontaminate.report(d, b), *DIGEST)
    assert got == Counter(brute_hits(docs, items))
    if limit:
        assert got == in_duckdb(decontaminate.SQL, DIGEST, documents=d, benchmark=b)


def test_decontamination_removes(spark):
    docs, items, d, b = benchmark_fixture(spark)
    bad = {r[0] for r in brute_hits(docs, items) if r[5]}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - bad
    spans = {r.doc_id: r.text for r in decontaminate.clean(d, b, remove="spans").collect()}
    assert spans[4] == "x y short item of five words" and spans[5] is None and spans[3] == docs[2][1] and spans[7] == ""
    with pytest.raises(ValueError):
        decontaminate.clean(d, b, remove="all")


def test_decontamination_of_odd_documents(spark):
    docs = odd_documents(spark)
    _, items, _, b = benchmark_fixture(spark)
    got = rows_of(decontaminate.report(docs, b), *DIGEST)
    assert got == Counter(brute_hits([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items))
    # every row is reported, also one that is hit and repeats, in one partition or in several
    again = b.select(F.lit(1).cast("long").alias("doc_id"), "text").union(docs.select("doc_id", "text"))
    again = again.union(again).repartition(3)
    rows = [(r.doc_id, r.text) for r in again.collect()]
    got = rows_of(decontaminate.report(again, b), *DIGEST)
    assert got == Counter(brute_hits(rows, items)) == in_duckdb(decontaminate.SQL, DIGEST, documents=again, benchmark=b)
    assert sum(got.values()) == len(rows)
    assert decontaminate.clean(again, b, remove="spans").count() == len(rows)
    assert decontaminate.report(no_documents(spark), b).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(docs, none).collect()} == {0}
    assert decontaminate.clean(docs, b).columns == docs.columns


# --- mixing -----------------------------------------------------------------------------------------------------------

def mixing_fixture(spark, big=600):
    rows = [(i, "big" if i < big else ("mid" if i < big + 60 else "small"), invented(i, 5 + i % 40)) for i in range(big + 70)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


MIXED = ("doc_id", "source", "epoch", "block", "token_offset", "n_tokens", "perm")


@pytest.mark.parametrize("max_sources", [100_000, 0])
def test_mixing(spark, monkeypatch, max_sources):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 16)
    monkeypatch.setattr(mixing, "MAX_SOURCES", max_sources)  # 0: sums by aggregates, the plan by a shuffle
    monkeypatch.setattr(mixing, "STEPS", 60 if max_sources else 32)
    docs = mixing_fixture(spark)
    got = mixing.mix(docs).collect()
    assert Counter(tuple(r[n] for n in MIXED) for r in got) == in_duckdb(mixing.SQL, MIXED, documents=docs)
    tokens = {r.source: r.t for r in docs.select("source", mixing.n_tokens(docs.text).alias("t")).groupBy("source").sum("t").withColumnRenamed("sum(t)", "t").collect()}
    plan = {r.source: r for r in mixing.source_plan(docs.select("source", mixing.n_tokens(docs.text).alias("n_tokens")), 0.98, 4.0, 1.0, 100_000).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9
    read = Counter()
    for r in got:
        read[r.source] += r.n_tokens
    for s, r in plan.items():
        assert r.tokens == tokens[s] and r.quota <= read[s] < r.quota + 50 and read[s] <= 4 * tokens[s] + 50
    # the smallest source is limited, so the entropy wanted is out of reach
    assert abs(plan["small"].quota / plan["small"].tokens - 4) < 0.01


def test_mixing_reaches_entropy(spark):
    import math

    docs = mixing_fixture(spark, 200)
    plan = mixing.source_plan(docs.select("source", mixing.n_tokens(docs.text).alias("n_tokens")), 0.9, 1e9, 0.5, 100_000).collect()
    assert abs(-sum(r.weight * math.log(r.weight) for r in plan) / math.log(3) - 0.9) < 1e-6


def test_mixing_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs, budget_share=1.0)
    assert {r.source for r in got.select("source").collect()} == {"a", "b", "c", None}
    mixed = mixing.mixed_documents(docs, budget_share=1.0)
    assert mixed.columns == docs.columns and mixed.filter("doc_id is null").count() >= 1
    empty = no_documents(spark)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert mixing.mix(blank).count() == 0


def test_every_row_is_mixed(spark):
    """Rows without a doc_id, with a repeated one or equal in all columns each count in their source."""
    rows = [(None, "a", invented(1, 20)), (None, "a", invented(2, 30)), (None, "b", invented(3, 40)), (None, "b", invented(3, 40)), (7, "a", invented(4, 25)),
            (7, "b", invented(5, 35)), (8, "a", invented(6, 15)), (8, "b", invented(6, 15)), (8, None, invented(6, 15)), (9, "c", "x y"), (9, "c", "x y"), (9, "c", "x y")]
    docs = spark.createDataFrame([(*r, None if i % 2 else i // 4) for i, r in enumerate(rows)], "doc_id long, source string, text string, n int")
    # the weights are the shares themselves, so that all is read once
    got = mixing.mixed_documents(docs, target_entropy=0.0, budget_share=1.0)
    assert rows_of(got, *docs.columns) == rows_of(docs, *docs.columns)


# --- surrogates ---------------------------------------------------------------------------------------------------------

FOUND = [r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\+1 \(\d+\) 555-\d{4}", r"\b\d{16}\b", r"\b[0-9a-f]{40}\b", r"\b\d{3}-\d{2}-\d{4}\b"]


def private_fixture():
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    return [(1, "Call +1 (017) 555-7713 or +1 (017) 555-7713, mail a.b@Mail7.example.com, A.B@MAIL7.EXAMPLE.COM and c.d@mail7.example.com"),
            (2, "card 4475383770160990 4475-3837-7016-0990 and 4111 1111 1111 1111, ip 10.0.0.1 and 010.0.0.1, 123-45-6789"),
            (3, "Mr. John Smith met Mrs. Mary Smith; Mr. Smith left. г-н Иван Петров"), (4, None), (5, ""), (6, f'token = "{secret}" TOKEN = "{secret.upper()}"'),
            (7, "x    1.2.3.4 again mail a.b@mail7.example.com"), (8, "version 2 has 17 parts in 2024, see 1.2.3"), (9, "a.b@mail7.example.com é.34@mail1.example.org")]


def luhn(number):
    digits = [int(c) for c in number][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark):
    rows = private_fixture()
    before = dict(rows)
    after = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k1").collect()}
    text = {i: r.text for i, r in after.items()}
    assert [after[i].n_entities for i in range(1, 10)] == [5, 6, 7, 0, 0, 2, 2, 0, 2]
    assert text[4] is None and text[5] == "" and text[8] == before[8]
    for i, t in rows:
        for p in FOUND:
            assert not set(re.findall(p, t or "")) & set(re.findall(p, text[i] or "")), (i, p)
    # format, case and coreference
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[1])
    assert len(phones) == 2 and phones[0] == phones[1]
    mails = re.findall(r"\S+@[\w.]+\w", text[1])
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() and mails[0].split("@")[1] == mails[2].split("@")[1] and mails[2] != mails[0]
    assert mails[0] in text[7] and mails[0] in text[9] and re.search(r"  ", text[7]) and re.search(r" [à-ü]\.\d\d@\w+\.example\.org", text[9])
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}", text[2])
    assert cards[0] == cards[1].replace("-", "") and cards[0][0] == "4" and luhn(cards[2].replace(" ", ""))
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", text[2])
    assert ips[0] == ips[1] and all(0 <= int(x) < 256 for x in ips[0].split("."))
    keys = re.findall(r'"(\w+)"', text[6])
    assert keys[0] == keys[1].lower() and keys[1].isupper() and re.fullmatch("[0-9a-f]{40}", keys[0])
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left\. г-н (\w+) (\w+)", text[3]).groups()
    assert names[0] in pii.GIVEN["latin", "given_m"].split() and names[2] in pii.GIVEN["latin", "given_f"].split() and names[1] == names[3] == names[4]
    assert re.fullmatch("[А-Яа-яё]+", names[5]) and re.fullmatch("[А-Яа-яё]+", names[6])
    again = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows[::-1], "doc_id long, text string"), "k1").collect()}
    assert again == text and pii.pseudonymise(spark.createDataFrame(rows[:1], "doc_id long, text string"), "k2").first().text != text[1]


def test_surrogates_stay_distinct(spark):
    """More first names than the list holds, and octets that crowd: no two entities share a surrogate, and none is real."""
    names = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)).capitalize() for i in range(0, 26 ** 4, 4001)]
    entities = spark.createDataFrame([("given_m", n) for n in names] + [("ssn", f"{i:09d}"[:2]) for i in range(0, 90)] + [("surname", n) for n in names], "type string, canon string")
    got = pii.surrogates(entities.distinct(), "k").collect()
    assert len({(r.type, r.sur) for r in got}) == len(got)
    assert not {(r.type, r.sur) for r in got} & {(r.type, r.canon) for r in got}


def test_names_never_run_out(spark):
    """More distinct names of each script than three syllables or a few given names can tell apart."""
    def names(letters, n):
        return ["".join(letters[(i // len(letters) ** k) % len(letters)] for k in range(5)).capitalize() for i in range(n)]

    latin, cyrillic, greek = names(string.ascii_lowercase, 24_000), names(pii.LETTERS["cyrillic"], 2_500), names("αβγδεζηθικλμνξοπρ", 2_500)
    rows = [("surname", n) for n in latin[:9_000] + cyrillic + greek] + [("given_m", n) for n in latin] + [("given_f", n) for n in greek]
    got = pii.surrogates(spark.createDataFrame(rows, "type string, canon string"), "k").collect()
    assert {(r.type, r.canon) for r in got} == set(rows) and len({(r.type, r.sur) for r in got}) == len(got) == len(rows)
    assert not {(r.type, r.sur) for r in got} & set(rows)
    script = lambda t: "cyrillic" if re.search("[а-яё]", t) else "greek" if re.search("[α-ωά-ώ]", t) else "latin"
    assert all(script(r.canon) == script(r.sur) for r in got)


def test_full_pools_grow(spark):
    """All one-letter and one-digit addresses of a domain, nearly all short telephone numbers: distinct all the same, and not real."""
    mails = [("email", f"{c}@host{d}.com") for d in range(20) for c in string.ascii_lowercase + string.digits]
    phones = [("phone", f"49|{i:04d}") for i in range(9_000)]
    got = pii.surrogates(spark.createDataFrame(mails + phones, "type string, canon string"), "k").collect()
    assert {(r.type, r.canon) for r in got} == set(mails + phones) and len({(r.type, r.sur) for r in got}) == len(got) == len(mails + phones)
    assert not {r.sur for r in got} & {c for _, c in mails + phones}
    by_domain = {r.canon.split("@")[1]: set() for r in got if r.type == "email"}
    for r in got:
        if r.type == "email":
            by_domain[r.canon.split("@")[1]].add(r.sur.split("@")[1])
    assert all(len(x) == 1 for x in by_domain.values())
    # written out, in the case and layout of the occurrence
    text = " ".join(f"{c.upper()}@HOST1.COM" for c in string.ascii_lowercase) + " call +49 12-34 or +49 1234"
    out = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = re.findall(r"[A-Z0-9]+@\S+", out.text)
    assert len(set(found)) == 26 and not set(found) & set(text.split()) and out.n_entities == 28
    assert re.search(r"call \+49 (\d\d)-(\d\d) or \+49 \1\2$", out.text)


def test_surrogates_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = pii.pseudonymise(docs)
    assert got.columns == docs.columns + ["n_entities"] and rows_of(got, "doc_id", "text") == rows_of(docs, "doc_id", "text")
    assert pii.pseudonymise(no_documents(spark)).count() == 0
    twice = pii.pseudonymise(got)
    assert twice.columns == got.columns
