"""Message history as tables.

``state_events`` is append-only; every "current" view is an aggregate over it.
Latest-value aggregates combine before the shuffle, so a message or
destination with very many events sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunked import newest_threshold

# Lifecycle states.
RECEIVED, FILTERED, TRANSFORMED, QUEUED, SENT, ERROR = (
    "RECEIVED", "FILTERED", "TRANSFORMED", "QUEUED", "SENT", "ERROR")
STATES = (RECEIVED, FILTERED, TRANSFORMED, QUEUED, SENT, ERROR)
SUMMARY = ["msg_id", "channel_id", "correlation_id", "replay_of", "state", "data_type", "error_text",
           "received_at", "updated_at"]
PAGE = 50


def record(df: DataFrame, channel: str, data_type: str, source_key: list[str], received_at: str,
           first_id: int = 1, meta: Column | None = None) -> DataFrame:
    """Stamp fresh messages RECEIVED.

    The correlation id is a hash of the source key, so re-reading a source
    gives the same ids; ``msg_id`` must already be present or is numbered by
    source key with a two-level sequence."""
    if "msg_id" not in df.columns:
        from .chunked import numbered
        slice_of = F.pmod(F.xxhash64(*source_key), F.lit(1 << 16))
        df = df.withColumn("__slice", slice_of)
        df = numbered(df, [], ["__slice", *source_key], F.col("__slice"), "msg_id").drop("__slice")
        df = df.withColumn("msg_id", F.col("msg_id") + (first_id - 1))
    empty = F.create_map().cast("map<string,string>")
    return df.withColumns({
        "channel_id": F.lit(channel), "data_type": F.lit(data_type), "state": F.lit(RECEIVED),
        "correlation_id": F.md5(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in source_key))),
        "replay_of": F.lit(None).cast("long"), "error_text": F.lit(""),
        "meta": empty if meta is None else meta,
        "received_at": F.col(received_at), "updated_at": F.col(received_at)})


def latest_message_state(events: DataFrame) -> DataFrame:
    own = events.filter(F.col("destination_id").isNull())
    last = F.max(F.struct("event_seq", "state", "error", "ts"))
    return own.groupBy("msg_id").agg(last.alias("e")).select(
        "msg_id", F.col("e.state").alias("state"), F.coalesce("e.error", F.lit("")).alias("error_text"),
        F.col("e.ts").alias("updated_at"))


def latest_destinations(events: DataFrame) -> DataFrame:
    """Current row per (message, destination).

    A NULL payload or meta keeps the stored one, the error text is always
    replaced, and QUEUED after the start resets the attempt budget."""
    d = events.filter(F.col("destination_id").isNotNull())
    seq = F.col("event_seq")
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), seq))
    when_state = lambda s: F.max_by("ts", F.when(F.col("state") == s, seq))
    return d.groupBy("msg_id", "destination_id").agg(
        F.max_by("state", seq).alias("state"), newest("payload").alias("payload"), newest("meta").alias("meta"),
        F.coalesce(F.max_by("error", seq), F.lit("")).alias("last_error"),
        (F.max_by("state", seq) == ERROR).alias("dead_letter"),
        when_state(QUEUED).alias("queued_at"), when_state(SENT).alias("sent_at"), F.max("ts").alias("updated_at"))


def list_messages(messages: DataFrame, channel: str | None = None, state: str | None = None,
                  before_id: int = 0, limit: int = 0) -> DataFrame:
    """Newest first keyset page; payload columns are never read."""
    limit = PAGE if limit <= 0 else limit
    if channel is not None:
        messages = messages.filter(F.col("channel_id") == channel)
    if before_id > 0:
        messages = messages.filter(F.col("msg_id") < before_id)
    if state:
        messages = messages.filter(F.col("state") == state)
    cols = [c for c in SUMMARY if c in messages.columns]
    return messages.select(*cols).orderBy(F.desc("msg_id")).limit(limit)


def dead_letters(messages: DataFrame, destinations: DataFrame, channel: str | None = None,
                 limit: int | None = None) -> DataFrame:
    d = destinations.filter("dead_letter").select(
        "msg_id", "destination_id", F.col("state").alias("destination_state"), "attempts", "last_error")
    m = messages.select(*[c for c in SUMMARY if c in messages.columns])
    if channel is not None:
        m = m.filter(F.col("channel_id") == channel)
    out = m.join(d, "msg_id")
    return out if limit is None else out.orderBy(F.desc("msg_id"), "destination_id").limit(limit)


def message_counts(messages: DataFrame, destinations: DataFrame) -> DataFrame:
    """channel_id, state, n; SENT and ERROR add destination outcomes.

    Destination outcomes are counted per message before they meet the
    messages, so the join never widens."""
    own = messages.groupBy("channel_id", "state").agg(F.count("*").alias("n"))
    per_msg = destinations.filter(F.col("state").isin(SENT, ERROR)).groupBy("msg_id", "state").agg(F.count("*").alias("n"))
    joined = per_msg.join(messages.select("msg_id", "channel_id"), "msg_id").groupBy("channel_id", "state").agg(
        F.sum("n").alias("n"))
    return own.unionByName(joined).groupBy("channel_id", "state").agg(F.sum("n").alias("n"))


def counts_rollup(messages: DataFrame, destinations: DataFrame) -> DataFrame:
    """The same outcomes as a rollup over channel, destination and state."""
    joined = destinations.select("msg_id", "destination_id", "state").join(
        messages.select("msg_id", "channel_id"), "msg_id")
    return joined.rollup("channel_id", "destination_id", "state").agg(F.count("*").alias("n"))


def queue_depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("channel_id", "destination_id").agg(F.count("*").alias("depth"))


def channel_summary(channels: DataFrame, counts: DataFrame, depth: DataFrame) -> DataFrame:
    of = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("n"))), F.lit(0)).cast("long")
    per = counts.groupBy("channel_id").agg(
        of(RECEIVED, TRANSFORMED).alias("received"), of(SENT).alias("sent"), of(ERROR).alias("errors"),
        of(FILTERED).alias("filtered"))
    queued = depth.groupBy("channel_id").agg(F.sum("depth").alias("queued"))
    names = ["received", "sent", "errors", "filtered", "queued"]
    return channels.join(per, "channel_id", "left").join(queued, "channel_id", "left").fillna(0, names)


def daemon_status(channels: DataFrame) -> DataFrame:
    return channels.agg(F.count("*").alias("channels"), F.count_if(F.col("status") == "running").alias("running"))


def retained(messages: DataFrame, queue: DataFrame, keep: int) -> DataFrame:
    """Messages a retention sweep keeps: the newest ``keep`` per channel and
    whatever the queue still references; -1 keeps everything."""
    if keep < 0:
        return messages
    limits = newest_threshold(messages, "channel_id", "msg_id", keep)
    pending = queue.select("channel_id", "msg_id").distinct().withColumn("__pending", F.lit(True))
    return (messages.join(limits, "channel_id", "left").join(pending, ["channel_id", "msg_id"], "left")
            .filter(F.col("threshold").isNull() | (F.col("msg_id") >= F.col("threshold")) | F.col("__pending"))
            .drop("threshold", "__pending"))


def pruned(messages: DataFrame, queue: DataFrame, keep: int) -> DataFrame:
    """The complement of :func:`retained`, as two anti joins."""
    if keep < 0:
        return messages.limit(0)
    limits = newest_threshold(messages, "channel_id", "msg_id", keep)
    old = messages.join(limits, "channel_id").filter(F.col("msg_id") < F.col("threshold")).drop("threshold")
    return old.join(queue.select("channel_id", "msg_id").distinct(), ["channel_id", "msg_id"], "left_anti")


def queue_heads(queue: DataFrame, destinations: DataFrame, now: Column) -> DataFrame:
    """Oldest pending delivery per destination with its stored payload.

    The head blocks its destination while ``not_before`` lies ahead; an
    orphaned head has no payload behind it.  The head is a minimum, so a
    destination holding most of the queue combines map-side."""
    head = queue.groupBy("channel_id", "destination_id").agg(
        F.min(F.struct("queue_id", "msg_id", "not_before")).alias("h")).select("channel_id", "destination_id", "h.*")
    d = destinations.select("msg_id", "destination_id", "payload", "attempts")
    return head.join(d, ["msg_id", "destination_id"], "left").withColumns({
        "orphaned": F.col("payload").isNull(), "attempts": F.coalesce("attempts", F.lit(0)),
        "ready": F.coalesce(F.col("not_before") <= now, F.lit(True))})


def message_detail(messages: DataFrame, destinations: DataFrame) -> DataFrame:
    """Messages with their destination outcomes as an ordered list."""
    listed = destinations.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct(
        "destination_id", "state", "attempts", "last_error", "dead_letter"))).alias("destinations"))
    return messages.join(listed, "msg_id", "left")


def failures(messages: DataFrame, destinations: DataFrame) -> DataFrame:
    """Dead letters and pipeline errors in one view."""
    dead = dead_letters(messages, destinations).select(
        F.lit("dead_letter").alias("kind"), "msg_id", "channel_id", "destination_id", F.col("last_error").alias("error"))
    bad = messages.filter(F.col("state") == ERROR).select(
        F.when(F.col("error_text").startswith("parse ("), "invalid").otherwise("pipeline").alias("kind"),
        "msg_id", "channel_id", F.lit(None).cast("string").alias("destination_id"), F.col("error_text").alias("error"))
    return dead.unionByName(bad)


def replay(messages: DataFrame, ids: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Fresh RECEIVED copies of stored messages: same bytes and correlation
    id, ``replay_of`` and meta ``replay.of`` name the original."""
    from .chunked import id_chunk, numbered
    chosen = messages.join(ids.select("msg_id").distinct(), "msg_id", "left_semi")
    chosen = numbered(chosen.withColumn("replay_of", F.col("msg_id")), [], ["replay_of"], id_chunk(F.col("replay_of")), "rn")
    return chosen.withColumns({
        "msg_id": F.col("rn") + (first_id - 1), "state": F.lit(RECEIVED), "error_text": F.lit(""),
        "received_at": now, "updated_at": now,
        "meta": F.create_map(F.lit("replay.of"), F.col("replay_of").cast("string"))}).drop("rn")


def requeue(destinations: DataFrame, queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with a verdict: accepted rows name an existing destination
    that is not already pending."""
    key = ["msg_id", "destination_id"]
    known = destinations.select(*key, F.lit(True).alias("__known"))
    pending = queue.select(*key, F.lit(True).alias("__pending")).distinct()
    return requests.join(known, key, "left").join(pending, key, "left").withColumn(
        "verdict", F.when(F.col("__known").isNull(), "no destination").when(F.col("__pending"), "already queued")
        .otherwise("queued")).drop("__known", "__pending")


def apply_requeue(destinations: DataFrame, accepted: DataFrame) -> DataFrame:
    """Destinations after a requeue: fresh attempts, payload kept."""
    hit = accepted.filter(F.col("verdict") == "queued").select("msg_id", "destination_id", F.lit(True).alias("__hit"))
    d = destinations.join(hit, ["msg_id", "destination_id"], "left")
    pick = lambda new, old: F.when(F.col("__hit"), new).otherwise(F.col(old))
    return d.withColumns({"state": pick(F.lit(QUEUED), "state"), "attempts": pick(F.lit(0), "attempts"),
                          "last_error": pick(F.lit(""), "last_error"),
                          "dead_letter": pick(F.lit(False), "dead_letter")}).drop("__hit")


def stage_payload(messages: DataFrame, destinations: DataFrame, stage: str) -> DataFrame:
    """(msg_id, payload, data_type) of 'received', 'transformed' or 'dest:<id>'."""
    if stage in ("", "received"):
        return messages.select("msg_id", F.col("raw").alias("payload"), "data_type")
    if stage == "transformed":
        return messages.filter(F.length("transformed") > 0).select(
            "msg_id", F.col("transformed").alias("payload"),
            F.coalesce(F.nullif("transformed_data_type", F.lit("")), F.col("data_type")).alias("data_type"))
    if stage.startswith("dest:"):
        return destinations.filter((F.col("destination_id") == stage[5:]) & (F.length("payload") > 0)).select(
            "msg_id", "payload", "data_type")
    raise ValueError(f'unknown stage "{stage}" (expected received, transformed, or dest:<id>)')
