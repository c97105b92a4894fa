"""Quality classifier: a factorisation machine over hashed words, structure statistics and length.

A text becomes a sparse vector: its words, hashed into ``DIM`` slots and weighted by damped count over the text's norm,
and ``STATS`` statistics of its structure.  The score is the logistic of  w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so pairwise interactions of all features cost time linear in the number of features.

Learning takes at most ``SAMPLE_ROWS`` labelled rows (the smallest hashes of doc_id, a documented bound) of those whose
crc32(doc_id as text) mod 4 is not 2; it runs in numpy on the driver over their vectors.  Scoring is one pass over the
documents.  Inputs are the text alone; labels, lang, source and doc_id never are.

Defined cases: NULL or empty text is scored like any other vector (no words); rows with NULL labels are left out of
learning; with no labelled rows at all every score is 1 (nothing is rejected without evidence); repeated rows are
scored alike, one row each; NULL doc_id counts as not held out.  Of a labelled doc_id that repeats every different text is
learnt from once, within twice the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared
from .words import ALNUM, NOT_BLANK, byte_table, owner, pieces, runs, span_hashes

DIM = 1 << 14
RANK = 8
SAMPLE_ROWS = 8_000
EPOCHS, STEPS = 10, 400
CUT = 0.7
_KINDS = [byte_table(lambda b: 65 <= b <= 90), byte_table(lambda b: 97 <= b <= 122), byte_table(lambda b: 48 <= b <= 57),
          byte_table(lambda b: b >= 128), byte_table(lambda b: b == 10), byte_table(lambda b: b < 128 and chr(b).isprintable() and not chr(b).isalnum() and b != 32),
          byte_table(lambda b: b in b".,;:?"), byte_table(lambda b: b in b"!"), byte_table(lambda b: b in b"#$%&*"), byte_table(lambda b: b in b"|<>{}[]=_\\")]
STATS = len(_KINDS) + 11


def vectors(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a piece of texts: row, slot and value of each hashed word, and the matrix of statistics."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    stats = np.zeros((n, STATS))

    def per_text(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[off[1:]] - sums[off[:-1]]

    for k, kind in enumerate(_KINDS):
        stats[:, k] = per_text(kind[raw]) / size
    starts, ends = runs(NOT_BLANK[raw], off)
    doc = owner(off, starts)
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    h = span_hashes(low, starts, ends)
    words = np.maximum(np.bincount(doc, minlength=n), 1).astype(float)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / words
    key = (doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    distinct, counts = np.unique(key, return_counts=True)
    whose = (distinct >> np.uint64(40)).astype(np.int64)
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    k = len(_KINDS)
    stats[:, k] = np.log1p(np.diff(off)) / 10
    stats[:, k + 1] = mean / 10
    stats[:, k + 2] = np.sqrt(np.maximum(np.bincount(doc, length ** 2, n) / words - mean ** 2, 0)) / 10
    stats[:, k + 3] = np.bincount(whose, minlength=n) / words
    stats[:, k + 4] = np.bincount(doc, again, n) / words
    most = np.zeros(n)
    np.maximum.at(most, whose, counts)
    stats[:, k + 5] = most / words
    stats[:, k + 6] = np.bincount(doc, ~ALNUM[last], n) / words
    stats[:, k + 7] = np.bincount(doc, length == 1, n) / words
    stats[:, k + 8] = np.bincount(doc, length > 20, n) / words
    stats[:, k + 9] = np.log1p(words) / 10
    stats[:, k + 10] = per_text(raw == 10) / words
    slot = (distinct & np.uint64(DIM - 1)).astype(np.int64)
    # one entry for each text and slot
    both, inverse = np.unique(whose * DIM + slot, return_inverse=True)
    value = np.log1p(np.bincount(inverse, counts)) if len(both) else np.zeros(0)
    row, slot = both // DIM, both % DIM
    norm = np.sqrt(np.maximum(np.bincount(row, value ** 2, n), 1e-12))
    return row, slot, value / norm[row], stats


def _sums(row, value, n):
    return np.stack([np.bincount(row, value[:, f], n) for f in range(value.shape[1])], 1)


class Machine:
    """w0, w and V over DIM word slots and STATS statistics, which are standardised."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(DIM + STATS)
        self.v = rng.normal(0, 0.02, (DIM + STATS, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def margin(self, row, slot, value, stats, n):
        z = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(STATS)
        vx = self.v[slot] * value[:, None]
        s = _sums(row, vx, n) + z @ self.v[DIM:]
        sq = np.bincount(row, (vx ** 2).sum(1), n) + (z ** 2) @ (self.v[DIM:] ** 2).sum(1)
        return self.w0 + np.bincount(row, self.w[slot] * value, n) + z @ self.w[DIM:] + 0.5 * ((s ** 2).sum(1) - sq), s, z

    def score(self, raw, off):
        m, _, _ = self.margin(*vectors(raw, off), len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))

    def learn(self, row, slot, value, stats, y, epochs=EPOCHS, steps=STEPS, rate=0.15, decay=1e-5, seed=2):
        n = len(y)
        # a small sample is gone through more often, in smaller batches
        batch = min(max(n // 40, 8), 256)
        epochs = max(epochs, -(-steps * batch // n))
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        rate0 = (y.sum() + 1) / (n + 2)
        self.w0 = float(np.log(rate0 / (1 - rate0)))
        begin = np.searchsorted(row, np.arange(n + 1))
        seen = [1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                ids = order[at:at + batch]
                lens = begin[ids + 1] - begin[ids]
                take = np.repeat(begin[ids] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
                r, s, x = np.repeat(np.arange(len(ids)), lens), slot[take], value[take]
                m, sums, z = self.margin(r, s, x, stats[ids], len(ids))
                g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[ids]) / len(ids)
                gw, gv = np.zeros(len(self.w)), np.zeros(self.v.shape)
                gx = g[r] * x
                gw[:DIM] = np.bincount(s, gx, DIM)
                gw[DIM:] = g @ z
                part = gx[:, None] * (sums[r] - self.v[s] * x[:, None])
                for f in range(RANK):
                    gv[:DIM, f] = np.bincount(s, part[:, f], DIM)
                gv[DIM:] = z.T @ (g[:, None] * sums) - ((z ** 2).T @ g)[:, None] * self.v[DIM:]
                gw += decay * self.w
                gv += decay * self.v
                g0 = g.sum()
                seen[0] += g0 ** 2
                seen[1] += gw ** 2
                seen[2] += gv ** 2
                self.w0 -= rate * g0 / np.sqrt(seen[0])
                self.w -= rate * gw / np.sqrt(seen[1])
                self.v -= rate * gv / np.sqrt(seen[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | None:
    """Learn from a bounded sample of labelled documents that are not held out; None without any."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and id is not null") \
        .filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in pieces(batch.column("text")):
                row, slot, value, stats = vectors(raw, off)
                cuts = np.searchsorted(row, np.arange(len(off)))
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("doc_id").slice(a, b - a), "y": batch.column("y").slice(a, b - a),
                    "slots": [slot[i:j].astype("<u2").tobytes() for i, j in zip(cuts, cuts[1:])],
                    "vals": [value[i:j].astype("<f4").tobytes() for i, j in zip(cuts, cuts[1:])],
                    "stats": [s.tobytes() for s in stats]})

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    # a doc_id that repeats brings its different texts, and of all of them the bound takes the first by hash
    keys = texts.select("doc_id", "y", "text_key").distinct().orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key", "y").limit(2 * sample_rows)
    rows = texts.join(F.broadcast(keys), ["doc_id", "y", "text_key"], "left_semi").dropDuplicates(["doc_id", "y", "text_key"]).select("doc_id", "y", "text") \
        .mapInArrow(featurise, "id long, y int, slots binary, vals binary, stats binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("y", "ascending"), ("vals", "ascending")]))
    slots = [np.frombuffer(x, "<u2") for x in rows["slots"].to_pylist()]
    machine = Machine()
    machine.learn(np.repeat(np.arange(len(slots)), [len(s) for s in slots]), np.concatenate(slots).astype(np.int64),
                  np.concatenate([np.frombuffer(x, "<f4") for x in rows["vals"].to_pylist()]).astype(float),
                  np.stack([np.frombuffer(x) for x in rows["stats"].to_pylist()]), rows["y"].to_numpy().astype(float))
    return machine


def with_score(docs: DataFrame, machine: Machine | None, column: str = "score") -> DataFrame:
    """The documents, all columns kept, with their score."""
    if machine is None:
        return docs.withColumn(column, F.lit(1.0))
    model = shared(docs.sparkSession, machine)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            got = [model().score(raw, off) for _, _, raw, off in pieces(some)]
            yield pa.array(np.concatenate(got) if got else np.empty(0), pa.float64())

    return docs.withColumn(column, score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    machine = fit(docs, labels, sample_rows)
    return with_score(docs.select("doc_id", "text"), machine) \
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns kept, that the classifier does not reject."""
    machine = fit(docs, labels, sample_rows)
    return with_score(docs, machine, "__score").filter(F.col("__score") >= cut).drop("__score")
