import hashlib
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
from fixtures import invented, no_documents, odd_documents
from pyspark.sql import functions as F

from segmenta.llm import language, quality, spotsigs, tokens, words


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# --- token output -------------------------------------------------------------------------------------------------------

def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2, 300, 70_000, 1 << 26):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ranks, control, data = tokens.encode_block(ids)
            assert tokens.decode_block(ranks, control, data, n).tolist() == ids.tolist()
    many = np.arange(70_000, dtype=np.uint32)  # ranks of three bytes
    assert tokens.decode_block(*tokens.encode_block(many), len(many)).tolist() == many.tolist()


def test_pieces_encode_like_whole_texts():
    texts = ["it's we'RE  don't,,, --'s 'tis", "a\n\nb \n c\t d  ", "  lead", "café×*÷ naïve's É. ß, Ünï", "x y   z　.", "12,5% 3.14 <|endoftext|> 漢字 。字 😀!", "", "a" * 5000,
             "\x00\x1c \x1d\x85\u0085 q", "word  word\n word\r\n\r\nword", "'s's ' s't", invented(3, 500)]
    encoder, whole = tokens.PieceEncoder(tokens.default_tokenizer()), tokenizer()
    for _ in range(2):  # from the tokenizer, then from the cache
        raw, off = words.byte_view(pa.array(texts))
        ids, counts = encoder.encode(raw, off)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_table(spark, tmp_path):
    docs = odd_documents(spark)
    got = tokens.token_digest(docs, str(tmp_path / "t"), block_tokens=50).orderBy("start").collect()
    t = tokenizer()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect()))
    ids = [t.encode(x[2], add_special_tokens=False).ids + [2] for x in rows]
    start = np.cumsum([0, *map(len, ids)])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [
        (x[1] if x[0] else None, int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for x, s, i in zip(rows, start, ids)]
    back = {(r.doc_id, tuple(r.ids)) for r in tokens.read_ids(spark, str(tmp_path / "t")).collect()}
    assert back == {(x[1] if x[0] else None, tuple(i)) for x, i in zip(rows, ids)}
    assert tokens.token_digest(no_documents(spark), str(tmp_path / "none")).count() == 0


# --- fingerprints -------------------------------------------------------------------------------------------------------

def test_fingerprints(spark):
    docs = odd_documents(spark)
    got = spotsigs.fingerprints_and_edits(docs).collect()
    rows = sorted(((r.doc_id is None, -(r.doc_id or 0), r.text or "", r.doc_id) for r in docs.select("doc_id", "text").collect()))
    texts = [r[2] for r in rows]
    want = []
    for r, t, following in zip(rows, texts, texts[1:] + texts[:1]):
        k = len(t) // 3
        edited = t[:len(t) - k] + following[:k]
        a, e, f = (set(x.tolist()) for x in spotsigs.signature_sets(pa.array([t, edited, following])))
        jaccard = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        want.append((r[3], len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(a, e), 9), round(jaccard(a, f), 9)))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
    same = {r.fingerprint for r in got if r.doc_id in (1, 6)}
    assert len(same) == 1 and {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert spotsigs.fingerprints_and_edits(no_documents(spark)).count() == 0
    one = spark.createDataFrame([(1, "the one and only document")], "doc_id long, text string")
    assert spotsigs.fingerprints_and_edits(one).first().near_next == 1.0


def test_signatures():
    a, b, c, d = spotsigs.signature_sets(pa.array(["the quick brown fox", "a cat; the Quick, brown!", "zebra yak", "?!"]))
    assert len(a) == 1 and set(a) < set(b) and len(b) == 2 and len(c) == 2 and len(d) == 1
    assert spotsigs.likeness(a, b) == 0.5 and spotsigs.likeness(a, b, 0.6) == 0.0
    assert spotsigs.read(spotsigs.written(b)).tolist() == b.tolist()


def test_near_pairs(spark):
    base = [f"the {invented(i, 6, 9000)} and {invented(i + 50, 5, 9000)} of {invented(i + 90, 4, 9000)} in {invented(i + 130, 4, 9000)} with {invented(i + 170, 4, 9000)}" for i in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" with ", " with new ")) for i, t in enumerate(base)] + [(200, base[0]), (201, None), (202, "")]
    sets = {i: set(s.tolist()) for (i, _), s in zip(rows, spotsigs.signature_sets(pa.array([t for _, t in rows], pa.string())))}
    got = {(r.a, r.b) for r in spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.6).collect()}
    ids = [i for i in sets if i != 200 and sets[i]]
    assert got == {(i, j) for i in ids for j in ids if i < j and sets[i] != sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])} and len(got) >= 15


# --- quality ------------------------------------------------------------------------------------------------------------

def test_machine_scores_pairs_in_linear_time():
    rng = np.random.default_rng(3)
    m = quality.Machine()
    m.v, m.w, m.w0 = rng.normal(0, 0.3, m.v.shape), rng.normal(0, 0.3, m.w.shape), 0.2
    raw, off = words.byte_view(pa.array(["some words and some more", "", "X!! Y!!"]))
    row, slot, value, stats = quality.vectors(raw, off)
    got, _, z = m.margin(row, slot, value, stats, 3)
    for i in range(3):
        x = np.zeros(len(m.w))
        x[slot[row == i]] = value[row == i]
        x[quality.DIM:] = z[i]
        on = np.flatnonzero(x)
        pairs = sum(m.v[a] @ m.v[b] * x[a] * x[b] for n, a in enumerate(on) for b in on[:n])
        assert math.isclose(got[i], m.w0 + m.w @ x + pairs, rel_tol=1e-9)


def quality_fixture(spark, n=600):
    docs = [(i, (invented(i, 60, 900).upper() + "!!" if i % 3 == 0 else invented(i, 60, 900))) for i in range(n)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(0, n, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_fixture(spark)
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) >= 0.98 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    # labels of held-out rows are never learnt
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.classify(docs, wrong).collect())) == sorted(map(tuple, got))
    kept = quality.accepted(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_of_odd_documents(spark):
    docs = odd_documents(spark)
    _, labels = quality_fixture(spark, 20)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (4, None, 0), (5, 7, None)], "doc_id long, quality int, toxic int"))
    got = quality.classify(docs, odd)
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.accepted(docs, odd).columns == docs.columns
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {1.0}
    assert quality.classify(no_documents(spark), labels).count() == 0


# --- language -----------------------------------------------------------------------------------------------------------

def language_fixture(spark, n=240):
    kinds = {"aa": ("ka", "lo", "mi", "nu"), "bb": ("sch", "ein", "ung", "ver"), "cc": ("ção", "nha", "lho", "que")}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("".join(rng.choice(kinds[lang], rng.integers(1, 5))) for _ in range(12)), lang) for i in range(n) for lang in [list(kinds)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    docs = language_fixture(spark)
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.lang_pred == want[r.doc_id] and r.score > 0.9 for r in held)
    blind = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(map(tuple, language.identify(blind).collect())) == sorted(map(tuple, got))


def test_language_does_not_depend_on_the_layout(spark):
    docs = language_fixture(spark)
    rare = spark.createDataFrame([(10_000 + i, "zhu shang xia " * 3, "rare") for i in range(4)], "doc_id long, text string, lang string")
    docs = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 5000)).union(rare)
    one, many = (sorted(map(tuple, language.identify(docs.repartition(n), per_language=30).collect())) for n in (1, 64))
    assert one == many
    # a language of a few documents is learnt, however many the others have
    assert {r[2] for r in one if r[0] >= 10_000} == {"rare"}
    picked = language.sample(docs, 30).groupBy("known").count().collect()
    assert {r.known: r["count"] for r in picked if r.known != "rare"} == {"aa": 30, "bb": 30, "cc": 30}


ALONE = """
import sys
sys.path.insert(0, {repo!r}); sys.path.insert(0, {tests!r})
from segmenta.session import session
from segmenta.llm import language, quality
from test_texts import language_fixture, quality_fixture
spark = session("alone", spark__master="local[2]", spark__ui__enabled="false", spark__driver__host="127.0.0.1")
print(spark.range(1).mapInArrow(lambda b: iter([]), "id long").count())
print(language.identify(language_fixture(spark)).count(), quality.classify(*quality_fixture(spark, 60)).count())
"""


def test_models_reach_workers_that_lack_the_package(tmp_path):
    here = os.path.dirname(os.path.abspath(__file__))
    script = ALONE.format(repo=os.path.dirname(os.path.dirname(here)), tests=here)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.stdout.split() == ["0", "240", "60"], got.stderr[-2000:]


def test_quality_of_a_doc_id_that_repeats(spark):
    docs, labels = quality_fixture(spark, 60)
    hot = spark.range(50_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("hot text "), (F.col("id") % 20_000).cast("string")).alias("text"))
    got = quality.classify(docs.union(hot), labels, sample_rows=50)
    assert got.count() == 50_060


def test_language_backs_off():
    """Known words decide; unknown ones go down to the n-grams that are known."""
    rows = [("aa", language.WORD, "xyz", 5), ("bb", language.WORD, "pqr", 5)]
    table = {"lang": [], "kind": [], "h": [], "n": []}
    for lang, kind, word, n in rows:
        raw, off = words.byte_view(pa.array([word]))
        hashes = {language.WORD: language.words_of(raw, off)[1], **{k: language.grams_of([word.encode()], k)[1] for k in language.ORDERS}}
        for k, hs in hashes.items():
            for h in hs.view(np.int64):
                for c, v in zip(("lang", "kind", "h", "n"), (lang, k, int(h), n)):
                    table[c].append(v)
    model = language.Model.of(pa.table({"lang": table["lang"], "kind": pa.array(table["kind"], pa.int32()), "h": pa.array(table["h"], pa.int64()), "n": table["n"]}))
    raw, off = words.byte_view(pa.array(["xyz", "pqr", "xyzzy", "qqq", "漢"]))
    best, score = model.predict(raw, off)
    assert [model.languages[i] for i in best[:4]] == ["aa", "bb", "aa", "bb"] and score[4] == 0.5 and score[0] >= score[2] > 0.5


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {2, 3, 4, 8} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(no_documents(spark)).count() == 0
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unknown).collect()} == {"und"}
