"""Vector code compression: each part of a vector becomes the index of the nearest of a few learnt entries.

Learning is exact: rounds of assigning every part to its nearest entry and moving entries to their parts' mean, in
integers.  It does not look at every point against every entry.  Points of a chunk are put, once a part position, into a
metric tree built middle-out by the anchors hierarchy: about the square root of their number of anchors, each new one the
point farthest from its anchor, steal nearer points (the triangle inequality tells which cannot be nearer); anchors are
merged in pairs upwards to one ball and divided downwards in the same way.  Balls cache the sum and the count of their
points.  A round walks the tree with a list of candidate entries that children inherit: an entry that another one beats
everywhere in the ball leaves the list, and a ball with one entry left is wholly owned: its cached sum and count are
taken without a look at its points.  What is left at the leaves is compared point by point, with what is left of the list.

The trees are written once, a row a chunk.  A round is one scan of them; each task returns at most one row per entry and
component, and the codebooks (parts x entries) are all that reaches the driver.

Defined cases: rows whose vector is NULL or holds NULL, NaN or infinite components are dropped.  The dimension is that of
the smallest kept vec_id; rows of another have a NULL code and error.  Where `parts` does not divide the dimension, parts
are as equal as they can be.  With fewer kept rows than entries the codebooks hold as many entries.  Ties: rows that share
a vec_id are ordered by their vectors, a NULL vec_id sorts last; equal distances go to the lower index.  Scaled components
are clamped to 2^61 in size; distances are exact at any size, and an error or a sum beyond a long is NULL.  Labels are
compared as text, NULLs together.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a chunk, points of a leaf at most.
CHUNK, LEAF = 8192, 64
#: Squared distances of components below this fit 64 bits.
SAFE, CLAMP = 1 << 28, 1 << 61
BROADCAST_BYTES = 8 << 20
TREE_SCHEMA = "vec_id array<bigint>, label array<string>, trees binary"
CODE_SCHEMA = "vec_id long, label string, code string, error long"


# --- metric trees -----------------------------------------------------------------------------------------------------

class Ball:
    def __init__(self, points: np.ndarray, kids: tuple = ()):
        self.points, self.kids = points, kids


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(-1))


def anchors(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Up to k groups of the points, each around an anchor."""
    owner, away = np.zeros(len(x), np.int64), _distance(x, x[0])
    pivots = [x[0]]
    while len(pivots) < k:
        far = int(away.argmax())  # the farthest point of the widest anchor
        if not away[far]:
            break
        new = x[far]
        half = _distance(np.stack(pivots), new) / 2
        # a point nearer to its anchor than half the way to the new one cannot be stolen
        open_ = np.flatnonzero(away > half[owner] * (1 - 1e-12))
        there = _distance(x[open_], new)
        stolen = there < away[open_]
        owner[open_[stolen]], away[open_[stolen]] = len(pivots), there[stolen]
        pivots.append(new)
    order = np.argsort(owner, kind="stable")
    return [g for g in np.split(order, np.searchsorted(owner[order], np.arange(1, len(pivots)))) if len(g)]


def _merged(balls: list[Ball], x: np.ndarray) -> Ball:
    """Pairs of balls are merged, those of the smallest common ball first, until one is left."""
    n = len(balls)
    centers = np.zeros((2 * n - 1, x.shape[1]))
    radii, sizes = np.zeros(2 * n - 1), np.zeros(2 * n - 1)
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)
    for i, b in enumerate(balls):
        centers[i], sizes[i] = x[b.points].mean(0), len(b.points)
        radii[i] = _distance(x[b.points], centers[i]).max()
    for i in range(n):
        cost[i, :i] = (_distance(centers[:i], centers[i]) + radii[:i] + radii[i]) / 2
    balls = list(balls)
    for new in range(n, 2 * n - 1):
        i, j = divmod(int(cost[:new, :new].argmin()), new)
        balls.append(Ball(np.concatenate([balls[i].points, balls[j].points]), (balls[i], balls[j])))
        sizes[new] = sizes[i] + sizes[j]
        centers[new] = (centers[i] * sizes[i] + centers[j] * sizes[j]) / sizes[new]
        radii[new] = max(_distance(centers[new], centers[i]) + radii[i], _distance(centers[new], centers[j]) + radii[j])
        for gone in (i, j):
            cost[gone], cost[:, gone], radii[gone] = np.inf, np.inf, np.inf
        if new < 2 * n - 2:
            cost[new, :new] = (_distance(centers[:new], centers[new]) + radii[:new] + radii[new]) / 2
    return balls[-1]


def _grown(x: np.ndarray, points: np.ndarray) -> Ball:
    if len(points) <= LEAF:
        return Ball(points)
    groups = anchors(x[points], int(np.ceil(np.sqrt(len(points)))))
    if len(groups) == 1:
        return Ball(points)  # all alike
    return _merged([_grown(x, points[g]) for g in groups], x)


class Tree:
    """The balls of a tree as arrays, the root first; points lie in the order of the leaves."""

    def __init__(self, x: np.ndarray):
        """x: integer points (m, width)."""
        flat = x.astype(float)
        nodes, kids, at = [_grown(flat, np.arange(len(x)))], [], 0
        while at < len(nodes):
            kids.append((len(nodes), len(nodes) + 1) if nodes[at].kids else (-1, -1))
            nodes.extend(nodes[at].kids)
            at += 1
        self.kids, leaves, stack = np.array(kids), [], [0]
        begin, end = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        done = 0
        while stack:  # left to right: a ball's points are contiguous
            i = stack.pop()
            begin[i], end[i] = done, done + len(nodes[i].points)
            if kids[i][0] < 0:
                leaves.append(nodes[i].points)
                done += len(nodes[i].points)
            else:
                stack += [kids[i][1], kids[i][0]]
        self.order = np.concatenate(leaves)
        self.begin, self.end, self.count = begin, end, end - begin
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        narrow = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        self.points = x[self.order].astype(narrow)
        exact = self.exact()
        sums = np.concatenate([np.zeros((1, x.shape[1]), exact.dtype), np.cumsum(exact, 0)])
        self.sums = sums[end] - sums[begin]
        self.center = self.sums.astype(float) / self.count[:, None]
        flat = flat[self.order]
        radius = [_distance(flat[b:e], c).max() for b, e, c in zip(begin.tolist(), end.tolist(), self.center)]
        self.radius = np.array(radius) * (1 + 1e-9) + 1e-6

    def exact(self, entries: np.ndarray | None = None) -> np.ndarray:
        """The points in a type in which squared distances (to the entries) are exact."""
        peak = max((max(-int(a.min()), int(a.max())) for a in (self.points, entries) if a is not None and a.size), default=0)
        return self.points.astype(np.int64 if peak < SAFE else object)

    def shares(self, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """Walk the tree with shrinking candidate lists: (balls, owner) of those owned, (leaves, candidates) of the rest."""
        k, near = len(entries), entries.astype(float)
        between = _distance(near[:, None, :], near[None, :, :])
        # an entry equal to an earlier one is never the nearest of the lowest index
        twin = np.array([any((entries[i] == entries[j]).all() for j in range(i)) for i in range(k)])
        balls, lists, owned, open_ = np.zeros(1, np.int64), ~twin[None, :], [], []
        scale = (near ** 2).sum(1).max(initial=0.0)
        while len(balls):
            c = self.center[balls]
            gap = ((c[:, None, :] - near[None, :, :]) ** 2).sum(2)
            best = np.where(lists, gap, np.inf).argmin(1)
            row = np.arange(len(balls))
            # beaten everywhere in the ball, with room for rounding
            margin = 1e-9 * (scale + (c ** 2).sum(1)) + 1e-3
            beaten = gap - gap[row, best][:, None] > 2 * self.radius[balls][:, None] * between[best] + margin[:, None]
            beaten[row, best] = False
            lists = lists & ~beaten
            one = lists.sum(1) == 1
            owned.append((balls[one], best[one]))
            leaf = ~one & (self.kids[balls, 0] < 0)
            open_.append((balls[leaf], lists[leaf]))
            down = ~one & ~leaf
            balls, lists = self.kids[balls[down]].reshape(-1), np.repeat(lists[down], 2, axis=0)
        return owned, open_

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Points left to compare, the entry of each, and the owned balls; exact."""
        owned, open_ = self.shares(entries)
        leaves = np.concatenate([x[0] for x in open_])
        lists = np.concatenate([x[1] for x in open_])
        n = self.count[leaves]
        rows = np.repeat(self.begin[leaves] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lists, x = np.repeat(lists, n, axis=0), self.exact(entries)
        best = np.full(len(rows), -1)
        least = np.zeros(len(rows), x.dtype)
        for e in range(len(entries)):
            mine = np.flatnonzero(lists[:, e])
            gap = ((x[rows[mine]] - entries[e].astype(x.dtype)) ** 2).sum(1)
            nearer = (best[mine] < 0) | (gap < least[mine])
            best[mine[nearer]], least[mine[nearer]] = e, gap[nearer]
        return rows, best, owned

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points nearest to each entry."""
        rows, best, owned = self.nearest(entries)
        sums, counts, x = np.zeros((len(entries), self.points.shape[1]), object), np.zeros(len(entries), np.int64), self.exact()
        for e in range(len(entries)):
            mine = rows[best == e]
            if len(mine):
                sums[e] += x[mine].sum(0)
                counts[e] += len(mine)
            for balls, owner in owned:
                got = balls[owner == e]
                if len(got):
                    sums[e] += self.sums[got].sum(0)
                    counts[e] += int(self.count[got].sum())
        return sums, counts

    def codes(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of every point and its squared distance, in the points' first order."""
        rows, best, owned = self.nearest(entries)
        code = np.zeros(len(self.order), np.int64)
        code[rows] = best
        for balls, owner in owned:
            n = self.count[balls]
            code[np.repeat(self.begin[balls] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(owner, n)
        x = self.exact(entries)
        gap = ((x - entries.astype(x.dtype)[code]) ** 2).sum(1)
        out, far = np.empty_like(code), np.empty(len(code), gap.dtype)
        out[self.order], far[self.order] = code, gap
        return out, far


# --- jobs -----------------------------------------------------------------------------------------------------------

def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<double>) of the rows that can be coded."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v")).filter(F.col("v").isNotNull() & fine)


def scaled(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Integers floor(scale * x)."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -float(CLAMP), float(CLAMP)).astype(np.int64)


def bounds(dimension: int, parts: int) -> list[int]:
    return [dimension * p // parts for p in range(parts + 1)]


def build_trees(rows: DataFrame, dimension: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """One row per chunk: its ids, labels and a tree per part position."""
    cuts = bounds(dimension, parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def chunk():
            t = pa.Table.from_batches(held).combine_chunks()
            x = scaled(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dimension), scale)
            trees = [Tree(x[:, a:b]) for a, b in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_pydict({"vec_id": pa.array([t["vec_id"].to_pylist()], pa.list_(pa.int64())),
                                               "label": pa.array([t["label"].to_pylist()], pa.list_(pa.string())),
                                               "trees": pa.array([pickle.dumps([vars(tree) for tree in trees], 5)], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, CHUNK - count))
                at, count = at + held[-1].num_rows, count + held[-1].num_rows
                if count == CHUNK:
                    yield chunk()
                    held, count = [], 0
        if count:
            yield chunk()

    return rows.select("vec_id", "label", "v").mapInArrow(build, TREE_SCHEMA)


def _trees(blob: bytes) -> list[Tree]:
    out = []
    for state in pickle.loads(blob):
        tree = Tree.__new__(Tree)
        tree.__dict__.update(state)
        out.append(tree)
    return out


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Move every entry to the mean of its parts."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, object) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for blob in batch.column("trees"):
                for p, tree in enumerate(_trees(blob.as_py())):
                    s, n = tree.totals(books[p])
                    sums[p] += s
                    counts[p] += n
        rows = [(p, e, i, str(v)) for p, s in enumerate(sums) for e in range(len(s)) if counts[p][e] for i, v in enumerate([int(counts[p][e]), *s[e]], -1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.string()))],
                                             names=["part", "entry", "at", "total"])

    got = trees.select("trees").mapInArrow(totals, "part int, entry int, at int, total string") \
        .groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # parts x entries x components
    moved, count = [b.astype(object) for b in books], {(r.part, r.entry): int(r.total) for r in got if r["at"] < 0}
    for r in got:
        if r["at"] >= 0:
            moved[r.part][r.entry, r["at"]] = int(r.total) // count[r.part, r.entry]
    return [m.astype(np.int64) for m in moved]


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[list[np.ndarray], DataFrame, int]:
    """(codebooks, stored trees, dimension) of (vec_id, embedding, label)."""
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    dimension = len(first[0].v) if first else 0
    same = [scaled(np.array(r.v, float), scale) for r in first if len(r.v) == dimension]
    cuts = bounds(dimension, parts)
    books = [np.array([v[a:b] for v in same], np.int64).reshape(len(same), b - a) for a, b in zip(cuts, cuts[1:])]
    trees = stored(build_trees(rows.filter(F.size("v") == dimension), dimension, parts, scale), "codes-trees")
    for _ in range(rounds if first else 0):
        books = _round(trees, books)
    return books, trees, dimension


def encode(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of every vector in the trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blob in zip(batch.column("vec_id"), batch.column("label"), batch.column("trees")):
                got = [tree.codes(books[p]) for p, tree in enumerate(_trees(blob.as_py()))]
                digits = np.stack([g[0] for g in got], 1).astype(np.uint8)
                text, width = digits.tobytes().hex(), 2 * digits.shape[1]
                error = sum((g[1].astype(object) for g in got[1:]), got[0][1].astype(object)) if any(g[1].dtype == object for g in got) else sum(g[1] for g in got)
                yield pa.RecordBatch.from_arrays([
                    ids.values, labels.values, pa.array([text[i:i + width] for i in range(0, len(text), width)], pa.string()),
                    pa.array([int(e) if e < 1 << 63 else None for e in error.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, CODE_SCHEMA)


def decode(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that a code stands for, as array<double>: its entries one after the other."""
    parts = []
    for p, book in enumerate(books):
        table = F.array(*(F.array(*(F.lit(float(v) / scale) for v in entry)) for entry in book.tolist()))
        parts.append(F.element_at(table, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1))
    return F.concat(*parts)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    books, trees, dimension = learn(vectors, parts, entries, rounds, scale)
    text = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    others = kept(vectors).filter(F.size("v") != dimension).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    codes = stored(encode(trees, books).unionByName(others), "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    hint = F.broadcast if small_enough(by_label, BROADCAST_BYTES, "of") else (lambda df: df)
    return codes.join(hint(by_label), F.col("label").eqNullSafe(F.col("of"))) \
        .select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB: a step of common tables per round."""
    kept_ = f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT vec_id, label, p, x[p * len(x) // {PARTS} + 1:(p + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) AS r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM d WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES}))"""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    steps = [kept_]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, d.p, min(struct_pack(g := CAST({gap} AS BIGINT), e := e)) AS best, any_value(x) AS x
      FROM d JOIN b{r} b ON d.p = b.p GROUP BY vec_id, label, d.p)""")
        if r < ROUNDS:
            mean = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
            steps.append(f"""
m{r} AS (SELECT p, e, list({mean} ORDER BY i) AS y FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
      FROM a{r}, range(1, len(x) + 1) AS t(i) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.y, b.y) AS y FROM b{r} b LEFT JOIN m{r} m USING (p, e))""")
    last = f"a{ROUNDS}"
    return "WITH" + ",".join(steps) + f""",
c AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.g) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS sha FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c, h"""


SQL = _sql()
