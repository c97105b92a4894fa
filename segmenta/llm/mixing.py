"""Temperature mixing: sources at flattened weights, realised as budgeted block permutations.

A source's share of all tokens p becomes the weight p^a / sum(p^a).  The exponent a in [0, 1] is bisected: the largest
one whose weights reach ``target_entropy`` (as a part of the entropy of equal weights), but no smaller than the
smallest one at which no source is read more than ``max_epochs`` times.  A source's quota is its weight times the
budget.  Every epoch of a source is a keyed permutation of its documents; whole epochs are read as long as the quota
lasts and the last one up to the document that reaches it.  The copies, in that order, are dealt evenly over the blocks
of the output, so that every block holds the sources at their weights.

How: sources' totals are one stored aggregate.  Up to ``MAX_SOURCES`` of them the bisection is an expression over the array
of totals and the plan is broadcast; above, every step's sums are an aggregate over the sources and the plan is joined by
a shuffle.  Running token counts of a permutation are taken in slices of the hash range whose number grows with
the source, so a source with a third of all rows is spread like any other.  No Python; texts are not shuffled.

Defined cases: NULL text has no tokens; NULL source is a source of its own; a source without tokens gets nothing; rows
that repeat are separate rows; an empty table gives an empty mix; ties in the permutation fall to the doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

STEPS = 60
MAX_SOURCES = 100_000
SLICE_ROWS = 4096


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_plan(counted: DataFrame, target_entropy: float, max_epochs: float, budget_share: float, block_tokens: int) -> DataFrame:
    """One row per source with tokens: source, tokens, n_docs, exponent, weight, quota, full_epochs, rest, n_blocks."""
    return _plan(_sources(counted), target_entropy, max_epochs, budget_share, block_tokens)


def _sources(counted: DataFrame) -> DataFrame:
    return stored(counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).filter("tokens > 0"), "sources")


def _by_sums(per: DataFrame, target_entropy: float, max_epochs: float, budget_share: float) -> DataFrame:
    """The sources with total, budget, exponent and z, the sums of every step taken over the table."""
    one = per.agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("k"), F.min("tokens").alias("least")).first()
    share = F.col("tokens").cast("double") / one.total
    sums = lambda a: per.agg(F.sum(F.pow(share, F.lit(a))).alias("z"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias("l")).first()
    low, high, low_epochs, high_epochs = 0.0, 1.0, 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        at = sums(mid)
        low, high = (mid, high) if math.log(at.z) - mid * at.l / at.z >= target_entropy * math.log(one.k) else (low, mid)
        mid = (low_epochs + high_epochs) / 2
        epochs = (one.least / one.total) ** mid / sums(mid).z / (one.least / one.total) * budget_share
        low_epochs, high_epochs = (mid, high_epochs) if epochs > max_epochs else (low_epochs, mid)
    exponent = round(max(low, high_epochs), 9)
    return per.select(F.lit(one.total).alias("total"), F.lit(math.floor(one.total * budget_share)).cast("long").alias("budget"), F.lit(exponent).alias("exponent"),
                      F.lit(sums(exponent).z).alias("z"), "tokens", "n_docs", "source")


def _by_array(per: DataFrame, target_entropy: float, max_epochs: float, budget_share: float) -> DataFrame:
    """The same for sources that fit an array, as one expression."""
    one = per.agg(F.collect_list(F.struct("tokens", "n_docs", "source")).alias("all"), F.sum("tokens").alias("total")) \
        .withColumn("all", F.expr("array_sort(all)")) \
        .withColumn("ps", F.expr("transform(all, x -> cast(x.tokens as double) / total)")) \
        .withColumn("budget", F.expr(f"cast(floor(total * {budget_share}D) as bigint)"))
    z = "aggregate(ps, 0D, (s, p) -> s + power(p, {a}))"
    ln = "aggregate(ps, 0D, (s, p) -> s + power(p, {a}) * ln(p))"
    mid = "(r.lo + r.hi) / 2D"
    entropy = f"ln({z}) - ({mid}) * {ln} / {z}".format(a=mid)
    # the smallest source is read most often: its weight over its share, times the budget over the total
    epochs = f"power(ps[0], {mid}) / {z} / ps[0] * {budget_share}D".format(a=mid)

    def bisect(low_when: str) -> str:
        return (f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (r, i) -> if({low_when}, "
                f"named_struct('lo', {mid}, 'hi', r.hi), named_struct('lo', r.lo, 'hi', {mid})))")

    one = one.withColumn("by_entropy", F.expr(bisect(f"{entropy} >= {target_entropy}D * ln(size(ps))"))) \
        .withColumn("by_epochs", F.expr(bisect(f"{epochs} > {max_epochs}D"))) \
        .withColumn("exponent", F.expr("round(greatest(by_entropy.lo, by_epochs.hi), 9)")) \
        .withColumn("z", F.expr(z.format(a="exponent")))
    return one.select("total", "budget", "exponent", "z", F.inline("all"))


def _plan(per: DataFrame, target_entropy: float, max_epochs: float, budget_share: float, block_tokens: int, many: bool | None = None) -> DataFrame:
    many = per.count() > MAX_SOURCES if many is None else many
    plan = (_by_sums if many else _by_array)(per, target_entropy, max_epochs, budget_share) \
        .withColumn("weight", F.expr("power(cast(tokens as double) / total, exponent) / z")) \
        .withColumn("quota", F.expr("cast(floor(weight * budget + 0.5D) as bigint)")) \
        .withColumn("full_epochs", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens")) \
        .withColumn("n_blocks", F.expr(f"greatest(1L, cast(ceil(cast(budget as double) / {block_tokens}) as bigint))"))
    return plan.select("source", "tokens", "n_docs", "exponent", "weight", "quota", "full_epochs", "rest", "n_blocks")


def mix(docs: DataFrame, target_entropy: float = 0.98, max_epochs: float = 4.0, budget_share: float = 1.0,
        block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """One row per copy in the mix: doc_id, source, epoch, block, token_offset, n_tokens, perm.

    Reading by (block, perm) gives the mixed order; token_offset counts the source's tokens before the copy.
    """
    counted = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    return mix_counted(counted, target_entropy, max_epochs, budget_share, block_tokens, seed)


def mix_counted(counted: DataFrame, target_entropy: float = 0.98, max_epochs: float = 4.0, budget_share: float = 1.0,
                block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """The same from (doc_id, source, n_tokens)."""
    per = _sources(counted)
    many = per.count() > MAX_SOURCES
    plan = _plan(per, target_entropy, max_epochs, budget_share, block_tokens, many).filter("quota > 0") \
        .withColumn("slices", F.expr(f"greatest(1L, (n_docs + {SLICE_ROWS - 1}) div {SLICE_ROWS})"))
    # one short row a source, broadcast where their number is known to be small
    plan = plan.withColumnRenamed("source", "s")
    copies = counted.join(plan if many else F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))) \
        .drop("s").withColumn("epoch", F.explode(F.expr("sequence(0, full_epochs)"))) \
        .filter("epoch < full_epochs or rest > 0") \
        .withColumn("perm", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))) \
        .withColumn("slice", F.expr("cast(conv(substr(perm, 1, 8), 16, 10) as bigint) * slices div 4294967296"))
    keys = ["source", "epoch", "slice"]
    before = copies.groupBy(*keys).agg(F.sum("n_tokens").alias("t")).withColumn(
        "before", F.coalesce(F.sum("t").over(Window.partitionBy("source", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("slice").alias("l"), "before")
    inside = Window.partitionBy(*keys).orderBy("perm", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))) \
        .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("slice") == F.col("l"))) \
        .withColumn("offset", F.expr("before + within")).filter("epoch < full_epochs or offset < rest") \
        .withColumn("token_offset", F.expr("epoch * tokens + offset"))
    block = F.expr("least(n_blocks - 1, cast(floor(cast(token_offset as double) / quota * n_blocks) as bigint))")
    return placed.select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), block.alias("block"), "token_offset", "n_tokens", "perm")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix with all their columns, one row per copy; texts move once, to meet their copies.

    Every row is a document of its own, also without a doc_id or with one that repeats; rows equal in all columns are
    told apart by a number.
    """
    flags = [f(F.col(c)) for c in docs.columns if c not in ("doc_id", "text") for f in (F.isnull, lambda x: x)]
    keyed = docs.withColumn("__key", F.concat_ws("|", F.isnull("doc_id").cast("string"), F.xxhash64("text").cast("string"),
                                                 F.xxhash64(F.isnull("text"), *flags).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    units = keyed.groupBy("__key", "source", n_tokens(F.col("text")).alias("n_tokens")).agg(F.count(F.lit(1)).alias("__rows")) \
        .withColumn("__number", F.explode(F.expr("sequence(1L, __rows)"))) \
        .select(F.concat_ws("|", F.col("__number").cast("string"), "__key").alias("doc_id"), "source", "n_tokens")
    copies = mix_counted(units, **params).groupBy(F.expr("substr(doc_id, instr(doc_id, '|') + 1)").alias("__key")).agg(F.count(F.lit(1)).cast("int").alias("__copies"))
    # equal rows are one row here, which is copied as often as all of them
    return keyed.join(copies, "__key").dropDuplicates(["__key"]) \
        .withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*docs.columns)


#: The same mix in DuckDB, at the default parameters.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
per AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, CAST(min(tokens) AS DOUBLE) / CAST(sum(tokens) AS BIGINT) AS p0, count(*) AS k,
               CAST(floor(CAST(sum(tokens) AS BIGINT) * 1.0::DOUBLE) AS BIGINT) AS budget, list(CAST(tokens AS DOUBLE) ORDER BY tokens) AS ts FROM per),
sh AS (SELECT list_transform(ts, lambda t: t / total) AS ps, p0, k, total, budget FROM tot),
bis AS (SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0::DOUBLE AS lo2, 1::DOUBLE AS hi2
  UNION ALL SELECT i + 1,
    CASE WHEN h >= 0.98::DOUBLE * ln(k) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= 0.98::DOUBLE * ln(k) THEN hi ELSE (lo + hi) / 2 END,
    CASE WHEN e > 4.0 THEN (lo2 + hi2) / 2 ELSE lo2 END, CASE WHEN e > 4.0 THEN hi2 ELSE (lo2 + hi2) / 2 END
  FROM (SELECT bis.*, k,
      ln(list_sum(list_transform(ps, lambda p: power(p, (lo + hi) / 2)))) - (lo + hi) / 2 * list_sum(list_transform(ps, lambda p: power(p, (lo + hi) / 2) * ln(p)))
         / list_sum(list_transform(ps, lambda p: power(p, (lo + hi) / 2))) AS h,
      power(p0, (lo2 + hi2) / 2) / list_sum(list_transform(ps, lambda p: power(p, (lo2 + hi2) / 2))) / p0 * 1.0 AS e
    FROM bis, sh WHERE i < 60)),
ex AS (SELECT round(greatest(lo, hi2), 9) AS a FROM bis WHERE i = 60),
pl AS (SELECT source, tokens, CAST(floor(power(CAST(tokens AS DOUBLE) / total, a) / z * budget + 0.5) AS BIGINT) AS quota,
              greatest(1, CAST(ceil(budget / 100000.0::DOUBLE) AS BIGINT)) AS n_blocks
       FROM per, (SELECT a, total, budget, list_sum(list_transform(ps, lambda p: power(p, a))) AS z FROM sh, ex)),
cp AS (SELECT d.*, pl.* EXCLUDE (source), unnest(range(0, quota // tokens + CASE WHEN quota % tokens > 0 THEN 1 ELSE 0 END)) AS epoch
       FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source WHERE quota > 0),
o AS (SELECT *, md5('7|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS perm FROM cp),
r AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY perm, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM o)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch,
       least(n_blocks - 1, CAST(floor(CAST(epoch * tokens + off AS DOUBLE) / quota * n_blocks) AS BIGINT)) AS block,
       CAST(epoch * tokens + off AS BIGINT) AS token_offset, n AS n_tokens, perm
FROM r WHERE epoch < quota // tokens OR off < quota % tokens
"""
