"""Mergeable sketches of a feed: kept per hour as binary, merged to any longer time without the rows.

Distinct values are a HyperLogLog sketch (relative standard error about 1.04 / sqrt(2^lg)), values a KLL quantile sketch
(rank error about 1.7 / k).  Both combine before the exchange, so an hour with a third of all rows is no hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2^LG registers, K items a level.
LG, K = 12, 400


def hourly(df: DataFrame, ts: str, distinct: Column, value: Column, *by: str, lg: int = LG, k: int = K) -> DataFrame:
    """by, hour, n, ids and quantiles (binary sketches); NULL ids and values count in n alone."""
    return df.groupBy(*by, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct, lg).alias("ids"), F.kll_sketch_agg_double(value.cast("double"), k).alias("quantiles"))


def merged(sketches: DataFrame, *by, shares: tuple[float, ...] = (0.5, 0.99), k: int = K) -> DataFrame:
    """by, n, distinct and one column per share (q50, q99, ...), from hours' sketches alone."""
    got = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("quantiles", k).alias("quantiles"))
    names = [F.col(c) if isinstance(c, str) else F.col(got.columns[i]) for i, c in enumerate(by)]
    marks = [F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(s))).alias(f"q{round(100 * s)}") for s in shares]
    return got.select(*names, "n", F.hll_sketch_estimate("ids").alias("distinct"), *marks)
