"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

A document's set are its distinct shingles of ``words`` words (A-Z lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer
words: the whole sequence as one).  Documents are linked if the Jaccard similarity of their sets is at least
``threshold``; components are what links reach.

1. One pass computes each set as 64-bit hashes, its key and its minimum under ``BANDS * ROWS`` permutations.  Documents
   with equal sets are one class from here on, however many they are.
2. Classes that share all minima of a band are in a bucket.  A pair at the threshold shares no band with a probability
   under 2e-7.
3. A bucket's pivot is its class with the most company; every other member meets the pivot first.  Pairs within one
   component need no test, so a large group of copies of one text ends here, with one pair a member.
4. Members of the buckets of a pivot that are still in different components meet each other, blockwise in numpy: the
   largest component in chunks against the others, and the others' chunks against each other.  A block gives only the
   links that connect something, so what it gives is bounded by its members.
5. A pair's signatures are compared in batches.  After n of them with m equal, the posterior of the similarity is
   Beta(m + 1, n - m + 1); the pair is dropped once the probability that it reaches the threshold is under ``miss``.
   Every survivor is confirmed on the full sets.

Links, components and texts stay in tables; the driver sees counts.  No group is taken into one task: pairs of a pivot
and chunks of a bucket are split.

Defined cases: NULL or empty text or no words: an empty set, linked with nothing.  A doc_id that repeats: rows with
equal sets count once; with different sets each is a document of its own, linked only by its text, and every row is
returned.  A component is named by its smallest doc_id; of several with the same smallest one, all but one are named by a
hash.  NULL doc_id: its text links like any other, the row is returned with a NULL component.  Other columns are ignored
by ``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import LOWER, NOT_BLANK, mixed, owner, per_process, pieces, runs, span_hashes

BANDS, ROWS, BATCH = 40, 5, 40
MISS = 1e-6
#: Members of a pivot or of a component that are compared in one group.
CHUNK = 256
#: Names of a set: of one that is not empty, by its key, and of an empty one, by its doc_id.
CLASS, EMPTY = "xxhash64(n, k1, k2)", "xxhash64('empty', doc_id)"


# --- sets and signatures --------------------------------------------------------------------------------------------

def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts in a row, and their offsets."""
    n = len(off) - 1
    low = LOWER[raw]
    starts, ends = runs(NOT_BLANK[low], off)
    h, doc = span_hashes(low, starts, ends), owner(off, starts)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    k = np.clip(count, 1, words)  # words of a shingle of this text
    many = np.where(count > 0, count - k + 1, 0)
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    size = np.repeat(k, many)
    s = size.astype(np.uint64)
    for i in range(words):
        here = size > i
        s[here] = mixed(s[here] * np.uint64(0x9FB21C651E98DF25) + h[at[here] + i])
    cuts = np.concatenate([[0], np.cumsum(many)])
    out = [np.unique(s[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each non-empty set (given by offsets) its minimum under every permutation."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    xor, odd = per_process("permutations", _permutations)
    out = np.empty((len(xor), len(off) - 1), np.uint32)
    for p in range(len(xor)):
        h = (x ^ xor[p]) * odd[p]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[p] = np.minimum.reduceat(h, off[:-1])
    return out.T


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t (the text's hash), n, k1, k2 (the set's key), sig (a byte a permutation), bands; the last two NULL for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in pieces(batch.column("text")):
                sets, so = shingle_sets(raw, off, words)
                n = np.diff(so)
                full = np.flatnonzero(n)
                k1, k2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                sig, bands = [None] * (b - a), [None] * (b - a)
                if len(full):
                    starts = so[:-1][full]
                    k1[full] = np.add.reduceat(sets, starts)
                    k2[full] = np.bitwise_xor.reduceat(mixed(sets + np.uint64(1)), starts)
                    m = minima(sets, np.append(starts, len(sets)))
                    grouped = m.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS)).copy()
                    for r in range(ROWS):
                        key = mixed(key * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, r])
                    for i, s, k in zip(full.tolist(), m.astype(np.uint8), key.view(np.int64)):
                        sig[i], bands[i] = s.tobytes(), k
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("t").slice(a, b - a), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "t", "n", "k1", "k2", "sig", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")) \
        .mapInArrow(run, "doc_id long, t long, n long, k1 long, k2 long, sig binary, bands array<bigint>")


# --- sequential verification ----------------------------------------------------------------------------------------

def least_matches(threshold: float, miss: float, n: int) -> int:
    """The fewest equal values among n at which the pair may still reach the threshold.

    With a uniform prior P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m).  Values are bytes, so that unequal minima
    are equal in one of 256 cases; t is raised accordingly.
    """
    t = threshold + (1 - threshold) / 256
    below = 0.0
    for m in range(n + 1):
        below += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log1p(-t))
        if below >= miss:
            return m
    return n


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which of the pairs (rows of a and b) survive the comparison, batch by batch."""
    least = per_process(("least", threshold, miss), lambda: {
        n: least_matches(threshold, miss, n) for n in (*range(BATCH, BANDS * ROWS, BATCH), BANDS * ROWS)})
    left = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for at in range(0, a.shape[1], BATCH):
        equal[left] += (a[left, at:at + BATCH] == b[left, at:at + BATCH]).sum(1, dtype=np.int32)
        left = left[equal[left] >= least[min(at + BATCH, a.shape[1])]]
        if not len(left):
            break
    return left


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def surviving(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule them out."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = may_reach(_signatures(batch.column("s1")), _signatures(batch.column("s2")), threshold, miss)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    sig1 = classes.select(F.col("id").alias("a"), F.col("sig").alias("s1"), F.col("n").alias("n1"))
    sig2 = classes.select(F.col("id").alias("b"), F.col("sig").alias("s2"), F.col("n").alias("n2"))
    sized = pairs.join(sig1, "a").join(sig2, "b").filter(F.least("n1", "n2") >= F.lit(threshold) * F.greatest("n1", "n2") - 1e-9)
    return sized.select("a", "b", "s1", "s2").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  a should be the one that repeats: its text moves less."""
    percent = round(threshold * 100)

    def check(key, left, right):
        links_a, links_b = [], []
        if left.num_rows and right.num_rows:
            texts_of = dict(zip(left["id"].to_pylist(), left["id_text"].to_pylist()))
            a_sets = {}
            for k, t in texts_of.items():
                for _, _, raw, off in pieces(pa.array([t], pa.string())):
                    a_sets[k] = shingle_sets(raw, off, words)[0]
            a_ids, at = right["a"].to_pylist(), 0
            b_ids = right["b"].to_pylist()
            for first, last, raw, off in pieces(right["text"].combine_chunks()):
                sets, so = shingle_sets(raw, off, words)
                for i in range(first, last):
                    x, y = a_sets[a_ids[i]], sets[so[i - first]:so[i - first + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        links_a.append(a_ids[i])
                        links_b.append(b_ids[i])
        return pa.table({"a": pa.array(links_a, pa.int64()), "b": pa.array(links_b, pa.int64())})

    # a's partners in parts of about CHUNK, so that a text with very many partners is not one group
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    parted = pairs.join(many, "a").withColumn("part", F.expr(f"pmod(xxhash64(b), (m + {CHUNK - 1}) div {CHUNK})"))
    right = parted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "part", "text")
    left = parted.select(F.col("a").alias("id"), F.col("part").alias("id_part")).distinct() \
        .join(texts.select("id", F.col("text").alias("id_text")), "id")
    return left.groupBy("id", "id_part").cogroup(right.groupBy("a", "part")).applyInArrow(check, "a long, b long")


# --- components -----------------------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every node of the links (a, b): the smallest id that links reach.

    Every round each node takes the smallest label around it, then the label of its label; only tables of nodes and
    links, written to the shared folder each round.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        lower = labels.join(around, "id").select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        target = lower.select(F.col("id").alias("t"), F.col("comp").alias("tc"))
        new = stored(lower.join(target, lower["comp"] == target["t"], "left")
                     .select("id", F.coalesce(F.least("comp", "tc"), "comp").alias("comp"), "old"), "labels")
        labels = new.select("id", "comp")
        if new.filter("comp != old").isEmpty():
            return labels


# --- links ----------------------------------------------------------------------------------------------------------

def classes_of(sketched: DataFrame) -> DataFrame:
    """One row for each distinct set that is not empty: id (a hash of its key), smallest (doc_id), n, sig, bands, and where its text is: none, d, t."""
    return sketched.filter("n > 0").groupBy("n", "k1", "k2") \
        .agg(F.min("doc_id").alias("smallest"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("d"), "t")).alias("at"),
             F.first("sig").alias("sig"), F.first("bands").alias("bands")) \
        .select(F.expr(CLASS).alias("id"), "smallest", "n", "sig", "bands", "at.*")


def links_between(classes: DataFrame, docs: DataFrame, threshold: float, miss: float, words: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect every component."""
    percent = round(threshold * 100)
    exploded = classes.select("id", F.explode("bands").alias("bucket"))
    size = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(exploded.join(size, "bucket"), "buckets")
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    places = classes.select("id", "none", "d", "t").join(company.select("id"), "id", "left_semi")
    near = stored(docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("t"), "text")
                  .join(places, ["none", "d", "t"]).dropDuplicates(["none", "d", "t"]).select("id", "text"), "bucket-texts")
    signed = classes.select("id", "n", "sig")

    ranked = members.join(company, "id")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("minus"))).alias("p")) \
        .select("bucket", (-F.col("p.minus")).alias("a"))
    # buckets with the same pivot are one group, so that a pair that shares many buckets is looked at once
    groups = stored(members.join(pivots, "bucket").select("a", "id").distinct(), "groups")
    star = stored(surviving(groups.filter("id != a").withColumnRenamed("id", "b"), signed, threshold, miss), "pairs")
    first = stored(confirmed(star, near, threshold, words), "links")

    labels = components(first)
    placed = groups.join(labels, "id", "left").select("a", "id", F.coalesce("comp", "id").alias("comp"))
    mixed_up = placed.groupBy("a", "comp").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("a").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("size"), F.count(F.lit(1)).alias("comps")).filter("comps > 1") \
        .select("a", F.col("most.comp").alias("major"), F.expr(f"(most.c + {CHUNK - 1}) div {CHUNK}").alias("majors"),
                F.expr(f"(size - most.c + {CHUNK - 1}) div {CHUNK}").alias("minors"))
    rest = placed.join(mixed_up, "a").withColumn("is_major", F.expr("comp = major")) \
        .withColumn("chunk", F.expr("pmod(xxhash64(id), if(is_major, majors, minors))"))
    # x: the chunk of the first side (majors are numbered after minors), y: a chunk of minors
    blocks = rest.withColumn("at", F.explode(F.expr("""if(is_major, transform(sequence(0, minors - 1), j -> struct(minors + chunk as x, j as y)),
        concat(transform(sequence(0, minors - 1), j -> struct(greatest(chunk, j) as x, least(chunk, j) as y)),
               transform(sequence(0, majors - 1), i -> struct(minors + i as x, chunk as y))))"""))) \
        .select("a", "at.x", "at.y", "id", "comp", "chunk", "is_major").join(signed, "id").join(near, "id")

    def across(key, table):
        """Links between the two sides of a block, as many as connect what they link."""
        x, y = key[1].as_py(), key[2].as_py()
        ids, comp, n = table["id"].to_numpy(), table["comp"].to_numpy(), table["n"].to_numpy()
        chunk, major, sig = table["chunk"].to_numpy(), table["is_major"].to_numpy(zero_copy_only=False), _signatures(table["sig"])
        low = np.flatnonzero(~major & (chunk == y))
        high = np.flatnonzero(major) if major.any() else np.flatnonzero(chunk == x)
        joined = {c: c for c in set(comp.tolist())}
        sets: dict[int, np.ndarray] = {}

        def root(c):
            while joined[c] != c:
                joined[c] = joined[joined[c]]
                c = joined[c]
            return c

        def set_of(i):
            if i not in sets:
                for _, _, raw, off in pieces(table["text"].slice(i, 1).combine_chunks()):
                    sets[i] = shingle_sets(raw, off, words)[0]
            return sets[i]

        a, b = [], []
        for i in low.tolist():
            others = high[(comp[high] != comp[i]) & (np.minimum(n[high], n[i]) >= threshold * np.maximum(n[high], n[i]) - 1e-9)]
            if not len(others):
                continue
            keep = others[may_reach(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], threshold, miss)]
            for j in keep.tolist():
                p, q = root(comp[i]), root(comp[j])
                if p != q:
                    mine, theirs = set_of(i), set_of(j)
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(theirs) - both):
                        joined[p] = q
                        a.append(ids[i])
                        b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    second = stored(blocks.groupBy("a", "x", "y").applyInArrow(across, "a long, b long"), "links")
    return first.union(second)


# --- the whole ------------------------------------------------------------------------------------------------------

def _placed(docs: DataFrame, threshold: float, words: int, miss: float) -> DataFrame:
    """doc_id, t, id (the set), n, component_id, kept of every document."""
    sketched = stored(sketches(docs, words), "sketches")
    classes = stored(classes_of(sketched), "classes")
    comp = components(links_between(classes, docs, threshold, miss, words))
    empty = sketched.filter("n = 0 and doc_id is not null").select(F.expr(EMPTY).alias("id"), F.col("doc_id").alias("smallest")).distinct()
    sets = stored(classes.select("id", "smallest").join(comp, "id", "left").select("id", "smallest", F.coalesce("comp", "id").alias("comp"), F.lit(False).alias("is_empty"))
                  .union(empty.select("id", "smallest", "id", F.lit(True))), "sets")
    # a component's first document, and of the components with the same first doc_id the one that has it as its name
    first = sets.filter("smallest is not null").groupBy("comp").agg(F.min(F.struct("smallest", "id")).alias("lead"), F.min("is_empty").alias("is_empty")) \
        .select("comp", F.col("lead.smallest").alias("lead"), F.col("lead.id").alias("lead_id"), "is_empty")
    owners = first.groupBy("lead").agg(F.min(F.struct("is_empty", "comp")).alias("o")).select("lead", F.col("o.comp").alias("owner"))
    names = first.join(owners, "lead").select("comp", "lead", "lead_id", F.expr("if(comp = owner, lead, comp)").alias("name"))
    named = sets.select("id", "comp").join(names, "comp").select("id", "lead", "lead_id", "name")
    return sketched.select("doc_id", "t", "n", F.expr(f"if(n > 0, {CLASS}, {EMPTY})").alias("id")).join(named, "id", "left") \
        .select("doc_id", "t", "id", "n", F.expr("if(doc_id is null, null, name)").alias("component_id"),
                F.expr("coalesce(doc_id = lead and id = lead_id, false)").alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _placed(docs, threshold, words, miss).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def one_of_each(docs: DataFrame, threshold: float = 0.8, words: int = 5, miss: float = MISS) -> DataFrame:
    """The documents, all columns kept, of which each group of near-duplicates keeps one, the one with the smallest doc_id.

    Of rows that share a doc_id and a set of shingles one is kept; rows without a doc_id all stay.
    """
    kept = _placed(docs, threshold, words, miss).filter("kept").groupBy(F.col("doc_id").alias("__id"), "id").agg(F.min("t").alias("__t")).select("__id", "__t")
    named = docs.filter("doc_id is not null").withColumns({"__id": F.col("doc_id").cast("long"), "__t": F.xxhash64("text")}) \
        .join(kept, ["__id", "__t"], "left_semi").dropDuplicates(["__id", "__t"]).select(*docs.columns)
    return named.union(docs.filter("doc_id is null"))
