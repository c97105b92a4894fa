"""Streams of messages: intake, fan-out, late rows, held answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.channel import Channel, run_channel


def dedupe_resends(stream: DataFrame, key: str = "control_id", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """At-least-once senders: one message per control id inside the delay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def start_channel(stream: DataFrame, channel: Channel, out: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Run a channel over a stream of (msg_id, raw, meta) rows.

    Every micro-batch is processed once and written under its batch number, so
    a batch that is run again after a failure replaces itself; stopping and
    restarting from the checkpoint loses nothing.  A destination that cannot
    be written does not keep the others from being written; the batch still
    fails afterwards and is retried as a whole."""

    def process(batch: DataFrame, batch_id: int) -> None:
        # The parsed outcome is written first and read back, so the fan-out to
        # the destinations neither parses again nor depends on cached blocks.
        messages, outcomes = run_channel(channel, batch)
        messages.write.mode("overwrite").parquet(f"{out}/messages/batch={batch_id}")
        staged = f"{out}/outcomes/batch={batch_id}"
        outcomes.write.mode("overwrite").parquet(staged)
        stored = batch.sparkSession.read.parquet(staged)
        failed = []
        for d in channel.destinations:
            try:
                stored.filter(F.col("destination_id") == d.id).write.mode("overwrite").parquet(
                    f"{out}/deliveries/destination={d.id}/batch={batch_id}")
            except Exception as e:  # isolation between destinations
                failed.append(f"{d.id}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def multi_sink(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
               available_now: bool = False) -> StreamingQuery:
    """The same rows to several sinks; one failing sink does not skip the rest."""

    def process(batch: DataFrame, batch_id: int) -> None:
        failed = []
        for name, sink in sinks.items():
            try:
                sink(batch, batch_id)
            except Exception as e:
                failed.append(f"{name}: {e}")
        if failed:
            raise RuntimeError("; ".join(failed))

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def count_only(df: DataFrame) -> int:
    """Discard the rows but count them in the same pass."""
    from pyspark.sql import Observation
    seen = Observation("discarded")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def split_late(batch: DataFrame, watermark: Column, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch against the watermark in force."""
    late = F.coalesce(F.col(ts) < watermark, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def late_side_table(on_time: str, late: str, delay: str, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rows behind max(event time) - delay go to a side
    table.

    The maximum after each batch is one row under ``<late>_marks``, so it
    survives restarts, costs nothing that grows with the rows written, and a
    batch that is run again sees what it saw before.  Only a missing folder
    means that there was no batch yet; any other failed read fails the batch."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(f"{late}_marks").filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            seen = None
        mark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        good, behind = split_late(batch, mark, ts)
        good.write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        behind.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        latest = batch.agg(F.greatest(F.max(ts), F.lit(seen).cast("timestamp")).alias("mark"))
        latest.write.mode("overwrite").parquet(f"{late}_marks/batch={batch_id}")

    return process


def hold_for_outcome(messages: DataFrame, outcomes: DataFrame, hold: str, late: str = "1 minute") -> DataFrame:
    """Answers within ``hold`` of the message; messages without one come out
    with a NULL code once the watermark has passed (timed out).

    ``messages``: control_id, ts; ``outcomes``: refers_to, answered_at, code."""
    m = messages.withWatermark("ts", late)
    o = outcomes.withWatermark("answered_at", late)
    cond = ((F.col("control_id") == F.col("refers_to")) & (F.col("answered_at") >= F.col("ts"))
            & (F.col("answered_at") <= F.col("ts") + F.expr(f"INTERVAL {hold}")))
    return m.join(o, cond, "left_outer")


def changes_since(events: DataFrame, last_seq: int, channel: str | None = None) -> DataFrame:
    """State changes after ``last_seq``; a consumer that is behind the start of
    the log first gets one resync row.  Resync rows pass the channel filter."""
    e = events.select("event_seq", "channel_id", "msg_id", "state", F.lit("message").alias("type"))
    if channel is not None:
        e = e.filter(F.col("channel_id") == channel)
    gap = events.agg(F.min("event_seq").alias("first")).filter(F.col("first") > last_seq + 1).select(
        (F.col("first") - 1).alias("event_seq"), F.lit(None).cast("string").alias("channel_id"),
        F.lit(None).cast("long").alias("msg_id"), F.lit(None).cast("string").alias("state"), F.lit("resync").alias("type"))
    return e.filter(F.col("event_seq") > last_seq).unionByName(gap)
