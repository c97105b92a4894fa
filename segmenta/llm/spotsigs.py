"""SpotSigs document fingerprints.

A spot signature is a common word (the anchor) with the ``CHAIN`` content words that follow it, common words between
them left out; at the end of a text the chain may be shorter.  A text's fingerprint is the set of its signatures as
sorted 32-bit hashes, written in base64; two fingerprints are as alike as the Jaccard similarity of their sets.

Defined cases: a text without any common word takes every word as an anchor; a text without words but with other
characters has one signature, of the whole text; an empty or NULL text has none and the empty fingerprint.  Two empty
fingerprints have likeness 1, an empty and another one 0.  Equal texts have equal fingerprints.  NULL doc_id sorts
last.  Documents with the same doc_id follow each other in the order of their texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, mixed, owner, pieces, runs, span_hashes

CHAIN = 2
#: Common words of English, German, French and Spanish.
COMMON = """
a an and are as at be by for from had has have he her his in is it its not of on or she that the their this to was were which who will with you
am auf aus bei das dass dem den der des die durch ein eine einem einen einer eines er es für ich im ist mit nach nicht noch oder sich sie sind
um und von vor war wie wir zu zum zur au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais nous par pas pour qu que
qui sa se ses son sont sur un une vous al como con del el ella ellos era esta este fue ha los las lo más muy nos para pero por su sus también una y
""".split()
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for _, _, raw, off in pieces(pa.array(words, pa.string())):
        out.append(span_hashes(raw, off[:-1], off[1:]))
    return np.sort(np.concatenate(out))


def signature_sets(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct 32-bit signatures of every text."""
    common = _hash_words(sorted(set(COMMON)))
    out: list[np.ndarray] = []
    lowered = pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)
    for _, _, raw, off in pieces(lowered):
        n = len(off) - 1
        starts, ends = runs(ALNUM[raw], off)
        doc = owner(off, starts)
        h = span_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        is_common = common[at] == h
        anchored = np.zeros(n, bool)
        anchored[doc[is_common]] = True
        every = ~anchored[doc] if len(doc) else np.zeros(0, bool)
        content = np.flatnonzero(~is_common)
        spots = np.flatnonzero(is_common | every)
        sig = h[spots].copy()
        nxt = np.searchsorted(content, spots, "right")
        for k in range(chain):
            there = nxt + k < len(content)
            j = content[np.minimum(nxt + k, max(len(content) - 1, 0))] if len(content) else np.zeros(len(spots), np.int64)
            there &= (doc[j] == doc[spots]) if len(content) else False
            sig = mixed(sig * np.uint64(0x100000001B3) + np.where(there, h[j] if len(h) else np.uint64(0), np.uint64(k + 1)))
        key = np.unique((doc[spots].astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
        cuts = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for i in range(n):
            s = low[cuts[i]:cuts[i + 1]]
            if not len(s) and off[i] < off[i + 1]:
                s = np.frombuffer(hashlib.sha256(raw[off[i]:off[i + 1]].tobytes()).digest()[:4], "<u4").copy()
            out.append(s)
    return out


def written(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look inside where the lengths alone keep it under at_least."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < at_least * max(len(a), len(b)) or not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_order(docs: DataFrame) -> DataFrame:
    """Documents dealt into ranges of descending doc_id, each range followed by the first document of the one after it.

    Columns: doc_id, text, part, ghost.  The ranges' bounds are quantiles of doc_id; a ghost is the document that a
    range needs of its successor (the last range, of the first).  One exchange of the texts.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n_parts for i in range(1, n_parts)]
    cuts = ids.approxQuantile("doc_id", probs, 0.25 / n_parts) if probs else []
    splits = sorted({float("-inf"), *(cuts or [0.0]), float("inf")})
    # descending: the range of the largest ids comes first, NULL ids last
    low = F.when(F.col("doc_id").isNull(), F.lit(float(len(splits)))).otherwise(F.lit(float(len(splits) - 2)) - F.col("b"))
    ranged = Bucketizer(splits=splits, inputCol="d", outputCol="b", handleInvalid="keep") \
        .transform(ids.withColumn("d", F.col("doc_id").cast("double"))).withColumn("part", low.cast("int")).drop("d", "b")
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()  # one row a range
    if not heads:
        return ranged.withColumn("ghost", F.lit(False))
    extra = [(heads[(i + 1) % len(heads)]["head"], h["part"]) for i, h in enumerate(heads)]
    ghosts = spark.createDataFrame(extra, "head long, ghost_part int").groupBy("head").agg(F.collect_list("ghost_part").alias("ghost_parts"))
    return ranged.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("head")), "left") \
        .withColumn("x", F.explode(F.expr("concat(array(struct(part as part, false as ghost)), "
                                          "transform(coalesce(ghost_parts, array()), p -> struct(p as part, true as ghost)))"))) \
        .select("doc_id", "text", "x.part", "x.ghost")


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and its likeness to that and to the next document.

    The edited text has its last floor(n/3) characters replaced by the first as many of the next document, by
    descending doc_id; after the last comes the first.
    """
    def ordered_rows(batches: Iterator[pa.RecordBatch]):
        """(current, next, fingerprints) of consecutive rows of a range, batch by batch; one row is carried over."""
        held = None
        for batch in batches:
            for a, b in _cuts(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                sets = signature_sets(texts)
                rows = list(zip(batch.column("doc_id").slice(a, b - a).to_pylist(), texts.to_pylist(), batch.column("part").slice(a, b - a).to_pylist(),
                                batch.column("ghost").slice(a, b - a).to_pylist(), sets))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                yield [(x, y) for x, y in zip(rows, rows[1:]) if not x[3] and x[2] == y[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in ordered_rows(batches):
            if not pairs:
                continue
            edited = []
            for (_, text, _, _, _), (_, following, _, _, _) in pairs:
                k = len(text) // 3
                edited.append(text[:len(text) - k] + following[:k])
            sets = signature_sets(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([x[0] for x, _ in pairs], pa.int64()),
                "n_chars": pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [written(x[4]) for x, _ in pairs],
                "edited_fingerprint": [written(s) for s in sets],
                "near_edited": pa.array([likeness(x[4], s) for (x, _), s in zip(pairs, sets)], pa.float64()),
                "near_next": pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64())})

    spread = in_order(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "part").sortWithinPartitions("part", "ghost", F.desc("doc_id"), "text").mapInArrow(run, SCHEMA)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b, _, _ in pieces(texts):
        yield a, b


# --- near-duplicate pairs ---------------------------------------------------------------------------------------------

def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness), a < b: distinct texts whose fingerprints are at least `threshold` alike.

    Equal fingerprints are one class, under their smallest doc_id.  A set of n signatures can only meet sets of
    threshold * n to n / threshold: classes are partitioned by length so that such sets share a partition or neighbours,
    and only pairs that share one of a set's rarest signatures (as many as must be shared) are compared.
    """
    def sets(batches):
        for batch in batches:
            for a, b in _cuts(batch.column("text")):
                got = signature_sets(batch.column("text").slice(a, b - a))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a),
                                                  "sigs": pa.array([s.astype(np.int64) for s in got], pa.list_(pa.int64()))})

    classes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets, "doc_id long, sigs array<bigint>") \
        .filter("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("sigs"))
    one = classes.select("id", "n", F.explode("sigs").alias("sig"))
    often = one.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = one.join(often, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("r"))
    rare = ranked.withColumn("keep", F.expr(f"n - cast(ceil(n * {threshold}D - 1e-9) as int) + 1")) \
        .withColumn("part", F.floor(F.log("n") / -np.log(threshold)).cast("int"))
    probe = rare.select("id", "n", "part", F.explode(F.expr("slice(r, 1, keep)")).alias("x")).select("id", "n", "part", "x.sig")
    other = probe.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "sig",
                         F.explode(F.expr("array(part - 1, part, part + 1)")).alias("part"))
    pairs = probe.join(other, ["part", "sig"]).filter(f"id < id2 and least(n, n2) >= {threshold}D * greatest(n, n2) - 1e-9") \
        .select("id", "id2").distinct()
    left = classes.select("id", F.col("sigs").alias("s1"))
    right = classes.select(F.col("id").alias("id2"), F.col("sigs").alias("s2"))
    return pairs.join(left, "id").join(right, "id2").withColumn("both", F.size(F.array_intersect("s1", "s2"))) \
        .withColumn("likeness", F.col("both") / (F.size("s1") + F.size("s2") - F.col("both"))) \
        .filter(F.col("likeness") >= threshold - 1e-12).select(F.col("id").alias("a"), F.col("id2").alias("b"), "likeness")
