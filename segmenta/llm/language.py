"""Language identification, word first: known words by their frequency, unknown ones by ever shorter character n-grams.

A word (a run of letters, lower-cased) that the model knows scores each language by the log of its frequency there.  An
unknown word is scored by its character n-grams of the longest order, of 5 down to 1, at which any of them is known: the
mean of their log frequencies.  A text takes the language with the greatest sum; its score is that language's posterior.

Learning counts words and n-grams per language in Spark, over at most ``SAMPLE_DOCS`` doc_ids a language (the smallest
hashes of doc_id, a documented bound) whose crc32(doc_id as text) mod 3 is not 1 and whose lang is known.  A word's n-grams
count once a language.  What it keeps is bounded by that sample, so it is broadcast.  Predictions read the text alone.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; so is every text if nothing could be
learnt.  Equal scores fall to the language that sorts first.  Repeated rows are predicted alike, one row each.  NULL
doc_id counts as not held out, and is not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared, small_enough, stored
from .words import LETTER, byte_view, mixed, owner, pieces, runs, span_hashes

SAMPLE_DOCS = 1_000
BROADCAST_BYTES = 8 << 20
MIN_COUNT = 2
ORDERS = (5, 4, 3, 2, 1)
WORD, EDGE = 0, 0x10FFFF


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, start and end of every word of lower-cased texts."""
    starts, ends = runs(LETTER[raw], off)
    return owner(off, starts), span_hashes(raw, starts, ends), starts, ends


def grams_of(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of all character n-grams of an order; a word's edges count as characters from order 2 on."""
    text = [w.decode("utf-8", "replace") for w in words]
    edge = chr(EDGE) if order > 1 else ""
    flat = np.frombuffer("".join(f"{edge}{t}{edge}" for t in text).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter((len(t) + 2 * len(edge) for t in text), np.int64, len(text))
    n = np.maximum(size - order + 1, 0)
    begin = np.cumsum(size) - size
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = np.full(len(at), order, np.uint64)
    for k in range(order):
        h = mixed(h * np.uint64(0x100000001B3) + flat[at + k])
    return np.repeat(np.arange(len(text)), n), h


class Model:
    """Per order (0: words) the sorted hashes known and their log frequency in each language."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables

    @staticmethod
    def of(rows: pa.Table) -> Model | None:
        """From counts (lang, kind, h, n)."""
        languages = sorted(set(rows["lang"].to_pylist()))
        if not languages:
            return None
        place = {x: i for i, x in enumerate(languages)}
        lang = np.array([place[x] for x in rows["lang"].to_pylist()])
        kind, h, n = rows["kind"].to_numpy(), rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
        tables = {}
        for k in (WORD, *ORDERS):
            mine = kind == k
            keys, inverse = np.unique(h[mine], return_inverse=True)
            counts = np.zeros((len(keys), len(languages)))
            np.add.at(counts, (inverse, lang[mine]), n[mine])
            total = counts.sum(0) + 0.5 * (len(keys) + 1)
            tables[k] = keys, np.log((counts + 0.5) / total)
        return Model(languages, tables)

    def look(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = self.tables[kind]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros((len(h), len(self.languages)))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        known = keys[at] == h
        return known, logs[at] * known[:, None]

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and posterior of the language of each (lower-cased) text."""
        n, languages = len(off) - 1, len(self.languages)
        doc, h, starts, ends = words_of(raw, off)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        known, logs = self.look(WORD, distinct)
        left = np.flatnonzero(~known)
        text = raw.tobytes()
        for order in ORDERS:
            if not len(left):
                break
            words = [text[s:e] for s, e in zip(starts[first[left]].tolist(), ends[first[left]].tolist())]
            word, g = grams_of(words, order)
            there, part = self.look(order, g)
            met = np.bincount(word, there, len(left))
            sums = np.stack([np.bincount(word, part[:, i], len(left)) for i in range(languages)], 1)
            found = met > 0
            logs[left[found]] = sums[found] / met[found, None]
            left = left[~found]
        total = np.stack([np.bincount(doc, logs[inverse, i], n) for i in range(languages)], 1)
        best = total.argmax(1)
        return best, 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(1)


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(id, known): the rows to learn from, the smallest hashes of doc_id of every language."""
    ids = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("known")).filter("id is not null and known is not null") \
        .filter(~held_out(F.col("id"))).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 24))
    # a language's share of hashes that holds about twice the bound is enough to rank, so no task ranks a whole language
    many = stored(ids.groupBy("known").agg(F.count(F.lit(1)).alias("m")), "languages")
    # broadcast where measured as small, so that only what is ranked is dealt out by language
    hint = F.broadcast if small_enough(many, BROADCAST_BYTES, "known") else (lambda df: df)
    some = ids.join(hint(many), "known").filter(F.col("h") < F.lit(float(1 << 40)) * (2 * per_language + 100) / F.col("m")).dropDuplicates(["id", "known"])
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("known").orderBy("h", "id"))).filter(F.col("rank") <= per_language).select("id", "known")


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS, min_count: int = MIN_COUNT) -> Model | None:
    """Count words and n-grams per language over a bounded sample of the documents that are not held out."""
    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = pc.utf8_lower(batch.column("text").fill_null(""))
            codes = batch.column("known").dictionary_encode()
            lang, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for a, b, raw, off in pieces(lowered):
                doc, h, starts, ends = words_of(raw, off)
                of, text = lang[a:b][doc], raw.tobytes()
                for i, name in enumerate(names):
                    mine = np.flatnonzero(of == i)
                    distinct, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    if len(distinct):
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(distinct), pa.string()), "n": pa.array(n.astype(np.int64)), "word": pa.array(
                            [text[s:e] for s, e in zip(starts[mine[first]].tolist(), ends[mine[first]].tolist())], pa.binary())})

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, words, n = batch.column("lang"), batch.column("word").to_pylist(), batch.column("n")
            _, h, _, _ = words_of(*byte_view(batch.column("word")))
            yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(words), WORD, np.int32)), pa.array(h.view(np.int64)), n], names=["lang", "kind", "h", "n"])
            for kind in ORDERS:
                word, g = grams_of(words, kind)
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(word)), pa.array(np.full(len(g), kind, np.int32)), pa.array(g.view(np.int64)),
                                                  pa.array(np.ones(len(g), np.int64))], names=["lang", "kind", "h", "n"])

    ids = sample(docs, per_language)
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("known")))
    # a word's n-grams count once a language, however many pieces or batches it was met in
    words = texts.select("text", "known").mapInArrow(word_counts, "lang string, n long, word binary").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = words.mapInArrow(gram_counts, "lang string, kind int, h long, n long") \
        .groupBy("lang", "kind", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.when(F.col("kind") == WORD, min_count).otherwise(1))
    return Model.of(rows.toArrow())


def identify(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = shared(docs.sparkSession, fit(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            lowered = pc.utf8_lower(texts)
            m = model()
            for a, b, raw, off in pieces(lowered):
                if m is None:
                    names, score = ["und"] * (b - a), np.zeros(b - a)
                else:
                    best, score = m.predict(raw, off)
                    names = [m.languages[i] if ok else "und" for i, ok in zip(best.tolist(), lettered[a:b])]
                    score = np.where(lettered[a:b], score, 0.0)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a),
                                                  "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text") \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
