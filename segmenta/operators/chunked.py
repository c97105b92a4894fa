"""Running values that survive a hot key.

A plain window over a key puts all of that key's rows into one task.  Here
each key's timeline is cut into chunks of the order column, the window runs
inside (key, chunk), and what earlier chunks contribute comes from one row per
chunk.  The result equals the plain window for any cut that is monotone in
the order.

The rows are shuffled once, by (keys, chunk) in a form that is never NULL.  The
per-chunk totals and the local windows read that exchange, and the carry, one
row per key and chunk, comes to the rows by plain equality on the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "__chunk"


def id_chunk(col: Column, rows: int = 1 << 20) -> Column:
    """Chunks of a unique integer sequence: at most ``rows`` rows each."""
    return F.floor(col / rows).cast("long")


def time_chunk(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).cast("long")


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
            **values: tuple[str, Column]) -> DataFrame:
    """Add one column per ``name=(kind, expression)``.

    kinds, all looking only at other rows of the same key:
      sum   total of earlier rows (0 when there is none)
      max   maximum of earlier rows
      last  latest non-NULL value among earlier rows
      next  earliest non-NULL value among later rows
    Wrap a value in a struct to make a NULL count as a value.
    """
    # NULL keys and chunks get a value of their own; strings, so that equality needs no coalesce that would not fit the exchange
    parts = [f"__p_{i}" for i in range(len(keys))]
    base = df.withColumns({p: F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for p, k in zip(parts, keys)})
    base = base.withColumn(CHUNK, F.coalesce(chunk.cast("long"), F.lit(-(1 << 62))))
    tmp = {}
    for name, (kind, expr) in values.items():
        tmp[name] = f"__v_{name}"
        base = base.withColumn(tmp[name], expr)
    base = base.repartition(*parts, CHUNK)
    seq = F.struct(*order)
    local = W.partitionBy(*parts, CHUNK).orderBy(*order)
    earlier = local.rowsBetween(W.unboundedPreceding, -1)
    later = local.rowsBetween(1, W.unboundedFollowing)
    chunks = W.partitionBy(*parts).orderBy(CHUNK)
    before = chunks.rowsBetween(W.unboundedPreceding, -1)
    after = chunks.rowsBetween(1, W.unboundedFollowing)
    totals, carried, own, final = [], [], {}, {}
    for name, (kind, _) in values.items():
        v, t, c, o = F.col(tmp[name]), f"__t_{name}", f"__c_{name}", f"__o_{name}"
        if kind == "sum":
            totals.append(F.sum(v).alias(t))
            carried.append(F.sum(t).over(before).alias(c))
            own[o] = F.sum(v).over(earlier)
            final[name] = F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(o), F.lit(0))
        elif kind == "max":
            totals.append(F.max(v).alias(t))
            carried.append(F.max(t).over(before).alias(c))
            own[o] = F.max(v).over(earlier)
            final[name] = F.greatest(F.col(c), F.col(o))
        elif kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), seq)).alias(t))
            carried.append(F.last(t, ignorenulls=True).over(before).alias(c))
            own[o] = F.last(v, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(o), F.col(c))
        elif kind == "next":
            totals.append(F.min_by(v, F.when(v.isNotNull(), seq)).alias(t))
            carried.append(F.first(t, ignorenulls=True).over(after).alias(c))
            own[o] = F.first(v, ignorenulls=True).over(later)
            final[name] = F.coalesce(F.col(o), F.col(c))
        else:
            raise ValueError(f"unknown kind {kind}")
    rows = base.withColumns(own)
    # The totals also touch every other column.  Without that their branch
    # would need fewer columns, its exchange would differ from the rows', and
    # everything below (often parsing) would run twice.
    per_chunk = base.groupBy(*parts, CHUNK).agg(*totals, F.max(F.xxhash64(*_hashable(base))).alias("__all"))
    carry = per_chunk.select(*(F.col(p).alias(f"__k{p}") for p in parts), F.col(CHUNK).alias("__k"), "__all", *carried)
    cond = (F.col(CHUNK) == F.col("__k")) & F.col("__all").isNotNull()
    for p in parts:
        cond = cond & (F.col(p) == F.col(f"__k{p}"))
    return rows.join(carry, cond, "left").select(*df.columns, *(e.alias(n) for n, e in final.items()))


def _hashable(df: DataFrame) -> list[Column]:
    """Every column in a form xxhash64 takes (maps by their entries)."""
    return [F.map_entries(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema.fields]


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn") -> DataFrame:
    """row_number() over the key, or over the whole table for ``keys=[]``."""
    return running(df, keys, order, chunk, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) + 1)


def newest_threshold(df: DataFrame, key: str, order: str, keep: int, width: int = 1 << 16) -> DataFrame:
    """(key, threshold): the ``keep``-th largest value of the unique integer ``order`` of each key.

    Values are counted by ranges of ``width``; only the range that holds the one wanted is sorted, and it holds at most
    ``width`` rows of a key however many ``keep`` asks for."""
    slim = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.floor(F.col(order) / width).cast("long").alias("__range"))
    counts = slim.groupBy("__key", "__range").agg(F.count("*").alias("n"))
    larger = W.partitionBy("__key").orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    holds = counts.withColumn("above", F.coalesce(F.sum("n").over(larger), F.lit(0))) \
        .filter((F.col("above") < keep) & (F.col("above") + F.col("n") >= keep)) \
        .select(F.col("__key").alias("__k"), F.col("__range").alias("__r"), "above")
    inside = slim.join(holds, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__range") == F.col("__r")))
    ranked = inside.withColumn("rn", F.col("above") + F.row_number().over(W.partitionBy("__key").orderBy(F.desc("__order"))))
    return ranked.filter(F.col("rn") == keep).select(F.col("__key").alias(key), F.col("__order").alias("threshold"))
