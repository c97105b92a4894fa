"""Spelling variant grouping: words that differ by one inserted, deleted or replaced code point, and what each is a form of.

Two words are near if their common prefix and common suffix together reach the longer length less one.  They are compared
by dense tiling: words lie in padded matrices of code points, left-aligned for prefixes and right-aligned for suffixes, in
blocks of ``BLOCK`` rows, and pairs of blocks are compared as a whole, column by column.

Which blocks meet: the edit of a near pair falls into some window of the longer length L, and outside it the words agree.
[0, L) is cut into ``WINDOWS`` windows; a word has one key a window (L, the window, the code points before and behind it)
for L equal to its length and for L one longer.  Words of one key meet.  A key with more than ``TILE`` words is taken
again with its window halved, and so on; a window of one code point holds at most as many words as the alphabet has
letters, so every key ends bounded and no word meets more than ``TILE`` words a key.  A pair counts in the window its edit
falls into (the first differing position) and so once.

Defined cases: NULL or empty texts have no words; a NULL doc_id is an empty text in the hash.  Runs of any length are
words.  Rows that repeat count each.  Ties of the largest n fall to the word that comes first in code-point order.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_LENGTH, MIN_COUNT, RATIO, CORRUPTED = 7, 2, 10, 31
WINDOWS, TILE, BLOCK = 3, 1024, 32
#: Cells of a comparison held at once.
CELLS = 1 << 21
PAIR_SCHEMA = "word string, near string, near_n long"


# --- words ----------------------------------------------------------------------------------------------------------

def words_of(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word): one row per run of letters of the documents, lower-cased, with the contract's deletions, of at least min_length."""
    # shorter runs cannot become long enough; a maximal run that is long enough is matched from its first letter to its last
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")) \
        .select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = run.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").alias("size"))
    at = F.when(F.col("h") % CORRUPTED == 0, (F.col("h") % F.col("size")).cast("int"))
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.col("size")))
    return hashed.select("run", "size", at.alias("at")) \
        .select(F.when(F.col("at").isNull(), F.col("run")).otherwise(cut).alias("word")).filter(F.length("word") >= min_length)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return words_of(docs, min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# --- dense tiles ----------------------------------------------------------------------------------------------------

def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left-aligned and right-aligned code points in matrices padded with 0, and the lengths."""
    text = words.to_pylist()
    size = np.fromiter(map(len, text), np.int64, len(text))
    flat = np.frombuffer("".join(text).encode("utf-32-le"), "<u4")
    flat = flat.astype(np.uint8 if not len(flat) or flat.max() < 256 else np.uint32)
    width = int(size.max(initial=0))
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(size)), size)
    left, right = np.zeros((len(size), width), flat.dtype), np.zeros((len(size), width), flat.dtype)
    left[row, column] = flat
    right[row, column + np.repeat(width - size, size)] = flat
    return left, right, size


def _agreeing(x: np.ndarray, y: np.ndarray, order: range) -> np.ndarray:
    """For each pair of rows of two blocks the number of columns, in that order, up to the first that differs."""
    same = np.ones((x.shape[0], x.shape[1], y.shape[1]), bool)
    met = np.zeros(same.shape, np.uint8 if x.shape[2] < 255 else np.int32)
    for c in order:
        # padding (0) differs from itself: 0 on one side is never equal to anything
        same &= (x[:, :, None, c] == y[:, None, :, c]) & (x[:, :, None, c] != 0)
        if not same.any():
            break
        met += same
    return met


def near_in_tiles(words: pa.Array, group: np.ndarray, begin: np.ndarray, end: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j), i < j, of the near pairs of each group; rows of a group are contiguous."""
    n = len(group)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    last = np.append(np.flatnonzero(group[1:] != group[:-1]), n - 1)
    # a block meets the blocks up to the one where the group of its last row ends
    reach = last[np.searchsorted(last, np.minimum(np.arange(1, blocks + 1) * BLOCK, n) - 1)] // BLOCK
    first = np.repeat(np.arange(blocks), reach - np.arange(blocks) + 1)
    second = first + np.arange(len(first)) - np.repeat(np.cumsum(reach - np.arange(blocks) + 1) - (reach - np.arange(blocks) + 1), reach - np.arange(blocks) + 1)
    left, right, size = code_points(words)
    tiled = [np.pad(a, [(0, pad)] + [(0, 0)] * (a.ndim - 1), constant_values=v).reshape(blocks, BLOCK, *a.shape[1:])
             for a, v in ((left, 0), (right, 0), (size, -9), (group, -1), (begin, 0), (end, 0), (longer, 0))]
    lefts, rights, sizes, groups, begins, ends, longers = tiled
    width, found = left.shape[1], []
    step = max(1, CELLS // (BLOCK * BLOCK + BLOCK * width))
    for at in range(0, len(first), step):
        a, b = first[at:at + step], second[at:at + step]
        # columns beyond the longest word of these blocks hold padding alone
        wide = int(max(sizes[a].max(), sizes[b].max()))
        prefix = _agreeing(lefts[a][:, :, :wide], lefts[b][:, :, :wide], range(wide)).astype(np.int64)
        suffix = _agreeing(rights[a][:, :, width - wide:], rights[b][:, :, width - wide:], range(wide - 1, -1, -1))
        si, sj = sizes[a][:, :, None], sizes[b][:, None, :]
        long = np.maximum(si, sj)
        edit = np.minimum(prefix, long - 1)
        ok = (groups[a][:, :, None] == groups[b][:, None, :]) & (prefix + suffix >= long - 1) & (abs(si - sj) <= 1) & (long == longers[a][:, :, None]) \
            & (edit >= begins[a][:, :, None]) & (edit < ends[a][:, :, None]) & ~((si == sj) & (prefix == si))
        k, i, j = np.nonzero(ok)
        i, j = a[k] * BLOCK + i, b[k] * BLOCK + j
        found.append((i[i < j], j[i < j]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# --- jobs -----------------------------------------------------------------------------------------------------------

def _key(begin: Column, end: Column) -> Column:
    """A hash of L, the window and what lies outside it; what it puts together too much the tiles tell apart."""
    # of the shorter word the part behind the window is the same number of code points from its end
    behind = F.col("longer") - end
    return F.xxhash64("longer", begin, end, F.substring("word", F.lit(1), begin), F.substring("word", F.length("word") - behind + 1, behind))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("word", "n", "longer", "begin", "end", _key(F.col("begin"), F.col("end")).alias("key"))


def near_pairs(words: DataFrame, windows: int = WINDOWS, tile: int = TILE) -> DataFrame:
    """(word, near, near_n): both directions of every near pair of the distinct words (word, n)."""
    cut = f"transform(sequence(0, {windows} - 1), j -> struct(cast(longer * j div {windows} as int) as begin, cast(longer * (j + 1) div {windows} as int) as end))"
    rows = _keyed(words.withColumn("size", F.length("word")).filter("size > 0")
                  .select("word", "n", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("longer"))
                  .select("word", "n", "longer", F.explode(F.expr(cut)).alias("w")).select("word", "n", "longer", "w.*").filter("begin < end"))
    ready = None
    while True:
        hot = rows.groupBy("key", "longer", "begin", "end").agg(F.count(F.lit(1)).alias("members")).filter((F.col("members") > tile) & F.expr("end - begin > 1")) \
            .select(F.col("key").alias("hot_key")).distinct()
        hot = stored(hot, "spelling-hot")
        none = hot.isEmpty()
        kept = rows if none else rows.join(hot, F.col("key") == F.col("hot_key"), "left_anti")
        ready = kept if ready is None else ready.unionByName(kept)
        if none:
            break
        halves = "array(struct(begin as begin, (begin + end) div 2 as end), struct((begin + end) div 2 as begin, end as end))"
        again = rows.join(hot, F.col("key") == F.col("hot_key"), "left_semi")
        # a hash may have put other windows of one code point beside a hot one: they have no halves
        split = again.select("word", "n", "longer", F.explode(F.expr(halves)).alias("w")) \
            .select("word", "n", "longer", F.col("w.begin").cast("int").alias("begin"), F.col("w.end").cast("int").alias("end")).filter("begin < end")
        rows = stored(_keyed(split), "spelling-rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            key, begin, end, longer = (t[c].to_numpy() for c in ("key", "begin", "end", "longer"))
            changes = (np.diff(key) != 0) | (np.diff(begin) != 0) | (np.diff(end) != 0) | (np.diff(longer) != 0)
            group = np.concatenate([[0], np.cumsum(changes)])
            # keys of one word compare nothing
            more = np.bincount(group)[group] > 1
            t = t.filter(pa.array(more))
            i, j = near_in_tiles(t["word"], group[more], begin[more], end[more], longer[more])
            one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
            return pa.RecordBatch.from_arrays([t["word"].combine_chunks().take(one), t["word"].combine_chunks().take(two), t["n"].combine_chunks().take(two)],
                                              names=["word", "near", "near_n"])

        for batch in batches:
            held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)]).combine_chunks()
            if not held.num_rows:
                continue
            key = held["key"].to_numpy()
            # the last key may go on in the next batch; it holds few rows
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if cut:
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held)

    return ready.repartition("key").sortWithinPartitions("longer", "key", "begin", "end").mapInArrow(compare, PAIR_SCHEMA)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, the forms followed to the last.

    Every form occurs RATIO times as often as its word, so chains are short (under 20 for counts of 64 bits), and the
    stride doubles each round.
    """
    edges = forms.select("word", F.col("form").alias("to"))
    step = edges
    while True:
        ahead = step.select(F.col("word").alias("at"), F.col("to").alias("beyond"))
        joined = stored(step.join(ahead, F.col("to") == F.col("at"), "left").select("word", F.coalesce("beyond", "to").alias("to"), F.col("at").isNotNull().alias("open")),
                        "spelling-roots")
        if joined.filter("open").isEmpty():
            return joined.select("word", F.col("to").alias("root"))
        step = joined.select("word", "to")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the documents."""
    words = stored(vocabulary(docs, min_length, min_count), "spelling-words")
    return grouped(words, ratio)


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """The same for distinct words (word, n) of any origin."""
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    likely = F.col("n_near").isNotNull() & (-F.col("best.minus") >= ratio * F.col("n"))
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.near")).alias("form"),
        F.when(likely, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    return found.join(roots(found.filter("form is not null")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
