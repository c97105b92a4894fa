"""Event-time windows; the same functions run on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunked import id_chunk, running

#: Slices of a key that one task looks at together.
SLICES = 4096


def _timed(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if df.isStreaming and late else df


def tumbling(df: DataFrame, size: str, *by: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    g = _timed(df, ts, late).groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


def sliding(df: DataFrame, size: str, step: str, *by: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    g = _timed(df, ts, late).groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, gap: str, *by: str, ts: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """Quiet gaps end a session.

    On a table no task gets all rows of a key.  Rows of one gap-wide slice of time always share a session, so an aggregate
    that combines before the exchange leaves a row a key and slice (first, last, count); slices that touch belong
    together, which running values over chunks of slices find out; sessions are an aggregate of them.  NULL times have no
    session."""
    if df.isStreaming:
        g = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
        return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    width = F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {gap})")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slices = df.filter(F.col(ts).isNotNull()).groupBy(*by, F.floor(at / width).cast("long").alias("__slice")) \
        .agg(F.min(at).alias("__first"), F.max(at).alias("__last"), F.count("*").alias("__n"))
    chunk = id_chunk(F.col("__slice"), SLICES)
    met = running(slices, list(by), ["__slice"], chunk, __before=("last", F.col("__last")))
    begins = F.when(F.col("__first") - F.col("__before") < width, 0).otherwise(1).cast("long")
    told = running(met.withColumn("__begins", begins), list(by), ["__slice"], chunk, __earlier=("sum", F.col("__begins")))
    g = told.groupBy(*by, (F.col("__earlier") + F.col("__begins")).alias("__session")) \
        .agg(F.min("__first").alias("start"), F.max("__last").alias("end"), F.sum("__n").alias("n"))
    return g.select(*by, F.timestamp_micros("start").alias("start"), F.timestamp_micros(F.col("end") + width).alias("end"), "n")
