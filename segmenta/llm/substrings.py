"""Suffix-array dedup: remove what is covered by a string of ``length`` bytes that also starts anywhere else.

Texts are UTF-8 bytes; matches never cross documents, the same document counts as elsewhere, overlaps count, and strings
are judged on the input, not on what is left.

1. Every window of ``length`` bytes has an anchor, the gram of ``GRAM`` bytes with the smallest hash in it (the first of
   equals).  Equal windows have equal anchors at equal places.  Neighbouring windows with one anchor form a context:
   the bytes from the first window's start to the last one's end.  So the unit is a context, not a byte.
2. Anchors that occur once cannot repeat and are dropped; equal contexts are put together and counted, so however often
   a text is copied, one context of it goes on.  All windows of a context that occurs twice repeat.
3. Contexts that share an anchor with a different one meet in a shard.  A shard builds the suffix array of its contexts
   (Larsson-Sadakane: prefixes double, only groups that are still unsorted are sorted again) and the common prefixes of
   neighbours (Kasai, in the order of the text: only where the preceding bytes differ are bytes compared).  Windows whose
   common prefix with the next window before or after reaches ``length`` repeat.
4. An anchor with more contexts than a shard may hold is dealt over several shards.  Each cuts the sorted hashes of its
   distinct windows at common bounds by binary search; whoever owns a range looks up every shard's part in the others'
   by binary search; what is met is sent back to the shards.

Hashes are of 64 bits and always used together with the anchor's, so a false match needs two collisions at once.

Defined cases: NULL or empty text: no bytes, nothing removed, the hash of nothing.  Texts shorter than ``length`` stay.
Rows that repeat are elsewhere to each other, and each is returned.  A doc_id with several texts: each is its own
document.  NULL doc_id is a document like any other.  Other columns are ignored by ``repeated_bytes`` and kept by
``without_repeats``; what is left of a cut character there becomes the replacement character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import _powers, byte_view, mixed, pieces

LENGTH = 400
GRAM = 128
#: Bytes of contexts in a shard.
SHARD_BYTES = 4 << 20
#: Window starts looked at together.
STRIDE = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


# --- anchors and contexts ---------------------------------------------------------------------------------------------

def contexts(raw: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start of the first window, number of windows, anchor's hash, context's hash) of all contexts."""
    n = len(raw)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mixed((sums[gram:] - sums[:n - gram + 1]) * down[:n - gram + 1])
    # hash above, place below: the smallest is the first of the smallest hashes
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size, width = 1, length - gram + 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[:size - width], low[width - size:])
    anchor = (low & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(anchor)]
    inside = np.arange(len(anchor)) + length <= off[1:][row]
    step = np.empty(len(anchor), bool)
    step[0], step[1:] = True, (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(inside & step)
    last = np.empty(len(anchor), bool)
    last[-1], last[:-1] = True, (anchor[1:] != anchor[:-1]) | ~inside[1:]
    end = np.flatnonzero(inside & last)
    at = anchor[start]
    shape = mixed((at - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (end - start).astype(np.uint64))
    return row[start], start - off[row[start]], end - start + 1, h[at], mixed(((sums[end + length] - sums[start]) * down[start]) ^ shape)


def _strides(raw: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets); a very long text comes in strides that overlap by a window less one byte."""
    if len(off) > 2 or len(raw) <= STRIDE + length:
        yield 0, 0, raw, off
        return
    for at in range(0, len(raw) - length + 1, STRIDE):
        part = raw[at:at + STRIDE + length - 1]
        yield 0, at, part, np.array([0, len(part)])


CONTEXTS = "doc_id long, x long, g array<bigint>, c array<bigint>, l array<int>, k array<int>"


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, x, g, c, l, k): each document's contexts: hashes of anchor and context, first window and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in pieces(batch.column("text")):
                got = []
                for first, place, part, part_off in _strides(raw, off, length):
                    row, l, k, g, c = contexts(part, part_off, length, gram)
                    got.append((row + first, l + place, k, g, c))
                row, l, k, g, c = (np.concatenate(x) for x in zip(*got))
                cuts = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in (
                    (g.view(np.int64), pa.int64()), (c.view(np.int64), pa.int64()), (l.astype(np.int32), pa.int32()), (k.astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("x").slice(a, b - a), *lists],
                                                 names=["doc_id", "x", "g", "c", "l", "k"])

    return docs.mapInArrow(run, CONTEXTS)


# --- suffix arrays ------------------------------------------------------------------------------------------------------

def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places sorted by what follows them up to their end (ends: for each place, where its own text ends).

    Larsson-Sadakane refinement: after sorting by h characters, the rank of place i + h is the next key of place i, and
    only places whose rank is shared are sorted again.  Equal suffixes stay in the order of their places.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    places = np.arange(n)
    for k in range(7):  # seven characters of nine bits; 0 stands for the end
        at = places + k
        key = (key << 9) | np.where(at < ends, text[np.minimum(at, n - 1)].astype(np.int64) + 1, 0)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = head
    h, longest = 7, int((ends - places).max()) if n else 0
    slots = np.arange(n)
    while h < longest:
        size = np.diff(np.append(np.flatnonzero(new), n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        who = order[slots]
        at = who + h
        after = np.where(at < ends[who], rank[np.minimum(at, n - 1)] + 1, 0)
        combined = rank[who] * (n + 1) + after
        by = np.argsort(combined, kind="stable")
        order[slots] = who[by]
        combined = combined[by]
        # a slot starts a group if its key differs from the slot before it, or it started one already
        new[slots[1:]] |= combined[1:] != combined[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[order[slots]] = head[slots]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted suffix with the one before it (0 for the first).

    Kasai: going through the places in the order of the text, the common prefix is one shorter than at the place before,
    unless the bytes before the two suffixes differ; only there bytes are compared.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    begin = np.concatenate([[True], ends[1:] != ends[:-1]])  # places where a text begins
    i = np.arange(n)
    fresh = begin | (before < 0) | begin[before] | (text[np.maximum(i - 1, 0)] != text[np.maximum(before - 1, 0)])
    todo = np.flatnonzero(fresh & (before >= 0))
    other = before[todo]
    room = np.minimum(ends[todo] - todo, ends[other] - other)
    got = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    span = np.arange(32)
    while len(live):
        a, b = todo[live] + got[live], other[live] + got[live]
        same = text[np.minimum(a[:, None] + span, n - 1)] == text[np.minimum(b[:, None] + span, n - 1)]
        run = np.where(same.all(1), 32, same.argmin(1))
        got[live] = np.minimum(got[live] + run, room[live])
        live = live[(run == 32) & (got[live] < room[live])]
    plcp = np.zeros(n, np.int64)
    plcp[todo] = got
    last = np.maximum.accumulate(np.where(fresh, i, 0))
    plcp = np.maximum(plcp[last] - (i - last), 0)
    return plcp[order]


def repeated_windows(parts: list[bytes], counts: np.ndarray, copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of contexts (their bytes, number of windows and of occurrences): context, place, and whether it repeats."""
    size = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.repeat(np.cumsum(size), size)
    order = suffix_array(text, ends)
    prefix = common_prefixes(text, ends, order)
    whose = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    is_window = place < counts[whose]
    kept = np.flatnonzero(is_window[order])  # windows only: other places belong to a neighbouring context
    if not len(kept):
        return whose[:0], place[:0], is_window[:0]
    # between windows the common prefix is the smallest on the way
    least = np.minimum.reduceat(prefix, np.append(kept[:-1] + 1, kept[-1])) if len(kept) > 1 else np.zeros(1, np.int64)
    same = np.concatenate([least[:-1] >= length, [False]])
    hit = same | np.concatenate([[False], same[:-1]])
    windows = order[kept]
    hit |= copies[whose[windows]] > 1
    back = np.argsort(windows)
    return whose[windows][back], place[windows][back], hit[back]


def _runs(hit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of hits within a row."""
    before = np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])])
    after = np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]])
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)


FOUND = "doc_id long, x long, first long, last long"


def _found(table: pa.Table, whose: np.ndarray, place: np.ndarray, hit: np.ndarray) -> pa.Table:
    """Runs of repeated windows, for contexts that occur once (the others are known to repeat as a whole)."""
    hit = hit & (table["n"].to_numpy()[whose] == 1)
    a, b = _runs(hit, whose)
    of = whose[a]
    start = table["l"].to_numpy()[of]
    return pa.table({"doc_id": table["doc_id"].take(pa.array(of)), "x": table["x"].take(pa.array(of)),
                     "first": pa.array(start + place[a], pa.int64()), "last": pa.array(start + place[b], pa.int64())})


def _windows(table: pa.Table, length: int):
    parts = table["bytes"].to_pylist()
    counts, copies = table["k"].to_numpy(), table["n"].to_numpy()
    return parts, repeated_windows(parts, counts, copies, length)


def _window_hashes(parts: list[bytes], whose: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(whose), np.uint64)
    cuts = np.searchsorted(whose, np.arange(len(parts) + 1))
    for i, p in enumerate(parts):
        raw = np.frombuffer(p, np.uint8)
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)])])
        at = place[cuts[i]:cuts[i + 1]]
        out[cuts[i]:cuts[i + 1]] = mixed((sums[at + length] - sums[at]) * down[at])
    return out


def shared_windows(snippets: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(doc_id, x, first, last): runs of windows that repeat, of contexts (g, c, n, doc_id, x, l, k, bytes)."""
    sizes = stored(snippets.groupBy("g").agg(F.sum(F.length("bytes")).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    parted = snippets.join(sizes.withColumn("parts", F.expr(f"(size + {shard_bytes - 1}) div {shard_bytes}")), "g") \
        .withColumn("shard", F.expr(f"if(parts > 1, g, pmod(xxhash64(g), {n_shards}L))")) \
        .withColumn("part", F.expr("pmod(xxhash64(c), parts)")) \
        .select("shard", "part", "parts", "g", "c", "n", "doc_id", "x", "l", "k", "bytes")

    def shard(key, table):
        _, (whose, place, hit) = _windows(table, length)
        return _found(table, whose, place, hit)

    found = parted.groupBy("shard", "part", "parts").applyInArrow(shard, FOUND)
    if sizes.filter(F.col("size") > shard_bytes).isEmpty():
        return found
    split = parted.filter("parts > 1")

    def cut(key, table):
        """The sorted hashes of a shard's distinct windows, cut at bounds that all shards of the anchor share."""
        parts, (whose, place, _) = _windows(table, length)
        h = np.unique(_window_hashes(parts, whose, place, length))
        m = key[2].as_py()
        bounds = (np.arange(1, m, dtype=object) * (1 << 64) // m).astype(np.uint64)
        cuts = [0, *np.searchsorted(h, bounds).tolist(), len(h)]
        return pa.table({"g": pa.array([key[0].as_py()] * m, pa.int64()), "range": pa.array(range(m), pa.int64()),
                         "part": pa.array([key[1].as_py()] * m, pa.int64()), "hashes": pa.array([h[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})

    def merge(key, table):
        """What each shard's part of a range shares with any other's, by binary search in their union."""
        lists = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        out = []
        for i, mine in enumerate(lists):
            met = np.zeros(len(mine), bool)
            for j, theirs in enumerate(lists):
                if i != j and len(theirs):
                    at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                    met |= theirs[at] == mine
            out.append(mine[met].tobytes())
        return pa.table({"g": table["g"], "part": table["part"], "hashes": pa.array(out, pa.binary())})

    def send_back(key, left, right):
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "x", "first", "last")})
        parts, (whose, place, _) = _windows(left, length)
        met = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right["hashes"].to_pylist())]))
        h = _window_hashes(parts, whose, place, length)
        at = np.minimum(np.searchsorted(met, h), max(len(met) - 1, 0))
        return _found(left, whose, place, met[at] == h if len(met) else np.zeros(len(h), bool))

    ranges = split.groupBy("shard", "part", "parts").applyInArrow(cut, "g long, range long, part long, hashes binary")
    merged = ranges.groupBy("g", "range").applyInArrow(merge, "g long, part long, hashes binary")
    return found.union(split.groupBy("shard", "part").cogroup(merged.groupBy("g", "part")).applyInArrow(send_back, FOUND))


# --- the whole ----------------------------------------------------------------------------------------------------------

def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, x, first, last): runs of window starts that repeat; x is xxhash64(text)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("x"), F.coalesce("text", F.lit("")).alias("text"))
    arrays = stored(anchored(source, length, gram), "contexts")
    each = arrays.select("doc_id", "x", F.explode(F.arrays_zip("g", "c", "l", "k")).alias("z")).select("doc_id", "x", "z.*")
    # aggregates are stored before they meet the rows: a join of two plain tables can be split where a key is hot
    often = stored(each.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("g").alias("og")), "anchors")
    live = stored(each.join(often, F.col("g") == F.col("og"), "left_semi"), "live-contexts")
    kinds = stored(live.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "x", "l")).alias("at"), F.first("k").alias("k")), "kinds")
    # all windows of a context that occurs more than once
    whole = live.join(kinds.filter("n > 1").select(F.col("g").alias("kg"), F.col("c").alias("kc")),
                      (F.col("g") == F.col("kg")) & (F.col("c") == F.col("kc")), "left_semi") \
        .select("doc_id", "x", F.col("l").cast("long").alias("first"), (F.col("l") + F.col("k") - 1).cast("long").alias("last"))
    several = stored(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select(F.col("g").alias("sg")), "shared-anchors")
    wanted = kinds.join(several, F.col("g") == F.col("sg"), "left_semi") \
        .select("g", "c", "n", "k", F.col("at.doc_id").alias("id"), F.col("at.x").alias("idx"), "at.l") \
        .groupBy("id", "idx").agg(F.collect_list(F.struct("g", "c", "n", "l", "k")).alias("wanted"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = byte_view(batch.column("text"))
            for i, (doc_id, x, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "x", "wanted")))):
                rows = {k: [w[k] for w in wanted] for k in ("g", "c", "n", "l", "k")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["g"], pa.int64()), pa.array(rows["c"], pa.int64()), pa.array(rows["n"], pa.int64()),
                     pa.array([doc_id] * len(wanted), pa.int64()), pa.array([x] * len(wanted), pa.int64()), pa.array(rows["l"], pa.int32()),
                     pa.array(rows["k"], pa.int32()), pa.array([raw[off[i] + w["l"]:off[i] + w["l"] + w["k"] + length - 1].tobytes() for w in wanted], pa.binary())],
                    names=["g", "c", "n", "doc_id", "x", "l", "k", "bytes"])

    snippets = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("x") == F.col("idx"))).select("doc_id", "x", "text", "wanted") \
        .mapInArrow(slices, "g long, c long, n long, doc_id long, x long, l int, k int, bytes binary")
    # rows that repeat bring their contexts more than once
    snippets = stored(snippets, "context-bytes").dropDuplicates(["g", "c"])
    return whole.union(shared_windows(snippets, length, shard_bytes))


def _with_runs(docs: DataFrame, length: int, gram: int, shard_bytes: int) -> DataFrame:
    runs = stored(repeated_runs(docs, length, gram, shard_bytes), "runs").groupBy(F.col("doc_id").alias("__id"), F.col("x").alias("__x")) \
        .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__runs"))
    return docs.withColumn("__xx", F.xxhash64("text")).join(
        runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__xx") == F.col("__x")), "left")


def _removed(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes (start, end)."""
    out: list[list[int]] = []
    for r in runs or ():
        a, b = r["first"], r["last"] + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _left(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                raw, spans = (text or "").encode(), _removed(runs, length)
                for k, v in zip(out, (len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_left(raw, spans)).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())],
                                             names=["doc_id", *out])

    return _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram, shard_bytes) \
        .select("doc_id", "text", F.col("__runs").alias("runs")) \
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, all columns kept, without their repeated bytes."""
    @F.udf("string", useArrow=True)
    def left(text, runs):
        return None if text is None else _left(text.encode(), _removed(runs, length)).decode("utf-8", "replace")

    return _with_runs(docs, length, gram, shard_bytes).withColumn("text", left("text", "__runs")).select(*docs.columns)
