"""Delivery outcomes replayed in batch from an attempts log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outcome import PERMANENT, SENT, TRANSIENT, backoff_seconds, exhausted
from .chunked import id_chunk, running

DELIVERY = ["destination_id", "msg_id"]
NO_PAYLOAD = "no payload recorded for this delivery"


def attempt_log(attempts: DataFrame, max_attempts: int, base: float = 1.0, cap: float = 300.0,
                chunk_rows: int = 1 << 20) -> DataFrame:
    """The log with each attempt's number, verdict and retry delay.

    ``attempts``: destination_id, msg_id, attempt_seq (unique), ts, outcome,
    error.  Attempts logged after the one that ended a delivery get
    ``counted`` false."""
    a = running(attempts, DELIVERY, ["attempt_seq"], id_chunk(F.col("attempt_seq"), chunk_rows),
                failed_before=("sum", F.when(F.col("outcome") == TRANSIENT, 1).otherwise(0)),
                ended_before=("sum", F.when(F.col("outcome").isin(SENT, PERMANENT), 1).otherwise(0)))
    n = F.col("failed_before") + 1
    dead = (F.col("outcome") == PERMANENT) | ((F.col("outcome") == TRANSIENT) & exhausted(n, max_attempts))
    over = F.lit(False) if max_attempts == -1 else F.col("failed_before") >= max_attempts
    verdict = F.when(F.col("outcome") == SENT, "SENT").when(dead, "ERROR").otherwise("QUEUED")
    return a.withColumns({
        "attempt": n.cast("int"), "counted": (F.col("ended_before") == 0) & ~over, "verdict": verdict,
        "retry_seconds": F.when(verdict == "QUEUED", backoff_seconds(n, base, cap))}).drop("failed_before", "ended_before")


def replay_deliveries(attempts: DataFrame, max_attempts: int, base: float = 1.0, cap: float = 300.0,
                      chunk_rows: int = 1 << 20) -> DataFrame:
    """One row per delivery: state, attempts, last_error, first and last
    attempt time, sent_at, next retry."""
    log = attempt_log(attempts, max_attempts, base, cap, chunk_rows).filter("counted")
    last = F.max(F.struct("attempt_seq", "verdict", "error", "ts", "retry_seconds"))
    failed = F.col("outcome") != SENT
    out = log.groupBy(*DELIVERY).agg(last.alias("l"), F.count_if(failed).cast("int").alias("attempts"),
                                     F.min("ts").alias("first_at"))
    state = F.col("l.verdict")
    return out.select(*DELIVERY, state.alias("state"), "attempts",
                      F.when(state == "SENT", "").otherwise(F.coalesce("l.error", F.lit(""))).alias("last_error"),
                      (state == "ERROR").alias("dead_letter"), "first_at", F.col("l.ts").alias("last_at"),
                      F.when(state == "SENT", F.col("l.ts")).alias("sent_at"),
                      F.when(state == "QUEUED", F.timestamp_add("SECOND", F.col("l.retry_seconds").cast("int"), F.col("l.ts"))
                             ).alias("not_before"))


def dead_letter_orphans(heads: DataFrame) -> DataFrame:
    """Queue heads with no payload behind them, as dead letters."""
    return heads.filter("orphaned").withColumns({
        "state": F.lit("ERROR"), "dead_letter": F.lit(True), "attempts": F.col("attempts") + 1,
        "last_error": F.lit(NO_PAYLOAD)})


def latency(deliveries: DataFrame) -> DataFrame:
    """Outcome counts and delivery latency per destination."""
    seconds = F.unix_micros("sent_at") / 1e6 - F.unix_micros("first_at") / 1e6
    return deliveries.withColumn("latency", F.when(F.col("sent_at").isNotNull(), seconds)).groupBy("destination_id").agg(
        F.count("*").alias("deliveries"), F.count_if(F.col("state") == "SENT").alias("sent"),
        F.count_if("dead_letter").alias("dead"), F.max("latency").alias("max_latency"),
        F.percentile_approx("latency", 0.5).alias("median_latency"))
