"""Queries over the message store, deliveries and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outcome
from ..functions.builder import new_message
from ..functions.delimited import ASTM, Parsed, parse_delimited
from ..operators import chains, delivery, store
from ..plans import translators as tr
from ..sources import captures
from . import feeds
from .feeds import parsed_hl7, table
from .registry import query

# The store as SQL: messages, destinations and queue of the order feed.
STORE = """
WITH m AS (SELECT o_orderkey AS msg_id, o_orderpriority AS channel_id, o_orderdate AS ts0,
  CASE o_orderstatus WHEN 'O' THEN 'RECEIVED' WHEN 'F' THEN 'TRANSFORMED' ELSE 'ERROR' END AS state,
  CASE WHEN o_orderstatus IN ('O', 'F') THEN '' WHEN o_orderkey % 2 = 0 THEN 'parse (hl7v2): hl7v2: empty message'
    ELSE 'translator 1: failed' END AS error_text FROM orders),
d AS (SELECT msg_id, channel_id, dest AS destination_id, ts0, msg_id % 4 AS attempts,
  CASE (msg_id + CASE dest WHEN 'csv' THEN 0 ELSE 1 END) % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'QUEUED' ELSE 'SENT' END AS state
  FROM m, (SELECT unnest(['csv', 'fhir']) AS dest) WHERE state = 'TRANSFORMED'),
q AS (SELECT msg_id * 2 + CASE destination_id WHEN 'csv' THEN 0 ELSE 1 END AS queue_id, * FROM d WHERE state = 'QUEUED')
"""


def _store(spark, sf):
    return feeds.stored_messages(spark, sf), feeds.stored_destinations(spark, sf), feeds.stored_queue(spark, sf)


@query("counts_by_channel", STORE + """
SELECT channel_id, state, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT channel_id, state, count(*) AS n FROM m GROUP BY ALL
  UNION ALL SELECT channel_id, state, count(*) FROM d WHERE state IN ('SENT', 'ERROR') GROUP BY ALL) GROUP BY ALL""")
def counts_by_channel(spark, sf):
    m, d, _ = _store(spark, sf)
    return store.message_counts(m, d)


@query("counts_rollup", STORE + """
SELECT channel_id, destination_id, state, count(*) AS n FROM d GROUP BY ROLLUP (channel_id, destination_id, state)""")
def counts_rollup(spark, sf):
    m, d, _ = _store(spark, sf)
    return store.counts_rollup(m, d.drop("channel_id"))


@query("queue_depth", STORE + "SELECT channel_id, destination_id, count(*) AS depth FROM q GROUP BY ALL")
def queue_depth(spark, sf):
    return store.queue_depth(feeds.stored_queue(spark, sf))


@query("channel_summary", STORE + """
SELECT channel_id, (SELECT count(*) FROM m WHERE m.channel_id = c.channel_id AND state IN ('RECEIVED', 'TRANSFORMED')) AS received,
  (SELECT count(*) FROM d WHERE d.channel_id = c.channel_id AND state = 'SENT') AS sent,
  (SELECT count(*) FROM m WHERE m.channel_id = c.channel_id AND state = 'ERROR') +
  (SELECT count(*) FROM d WHERE d.channel_id = c.channel_id AND state = 'ERROR') AS errors,
  (SELECT count(*) FROM q WHERE q.channel_id = c.channel_id) AS queued, 0 AS filtered
FROM (SELECT DISTINCT channel_id FROM m) c""")
def channel_summary(spark, sf):
    m, d, q = _store(spark, sf)
    return store.channel_summary(m.select("channel_id").distinct(), store.message_counts(m, d), store.queue_depth(q))


@query("channel_status", "SELECT 5 AS channels, count(DISTINCT o_orderpriority) FILTER (o_orderpriority < '4') AS running FROM orders")
def channel_status(spark, sf):
    m = feeds.stored_messages(spark, sf).select("channel_id").distinct()
    return store.daemon_status(m.withColumn("status", F.when(F.col("channel_id") < "4", "running").otherwise("stopped")))


@query("newest_page", STORE + """
SELECT msg_id, channel_id, state, error_text FROM m WHERE channel_id = '2-HIGH' AND state = 'ERROR' AND msg_id < 500 ORDER BY msg_id DESC LIMIT 50""")
def newest_page(spark, sf):
    return store.list_messages(feeds.stored_messages(spark, sf), "2-HIGH", "ERROR", before_id=500).select(
        "msg_id", "channel_id", "state", "error_text")


@query("dead_letters", STORE + """
SELECT m.msg_id, m.channel_id, destination_id, attempts, 'refused' AS last_error, m.state FROM d JOIN m USING (msg_id) WHERE d.state = 'ERROR'""")
def dead_letters(spark, sf):
    m, d, _ = _store(spark, sf)
    return store.dead_letters(m, d.drop("channel_id")).select("msg_id", "channel_id", "destination_id", "attempts", "last_error", "state")


@query("dead_letter_page", STORE + """
SELECT m.msg_id, destination_id FROM d JOIN m USING (msg_id) WHERE d.state = 'ERROR' AND m.channel_id = '5-LOW' ORDER BY msg_id DESC, destination_id LIMIT 20""")
def dead_letter_page(spark, sf):
    m, d, _ = _store(spark, sf)
    return store.dead_letters(m, d.drop("channel_id"), "5-LOW", 20).select("msg_id", "destination_id")


_KEEP = STORE + """, r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY msg_id DESC) AS rn FROM m),
kept AS (SELECT * FROM r WHERE rn <= 100 OR (channel_id, msg_id) IN (SELECT (channel_id, msg_id) FROM q)) """


@query("retained_messages", _KEEP + "SELECT msg_id, channel_id FROM kept")
def retained_messages(spark, sf):
    m, _, q = _store(spark, sf)
    return store.retained(m, q, 100).select("msg_id", "channel_id")


@query("pruned_messages", _KEEP + "SELECT channel_id, count(*) AS n, max(msg_id) AS newest FROM r WHERE msg_id NOT IN (SELECT msg_id FROM kept) GROUP BY 1")
def pruned_messages(spark, sf):
    m, _, q = _store(spark, sf)
    return store.pruned(m, q, 100).groupBy("channel_id").agg(F.count("*").alias("n"), F.max("msg_id").alias("newest"))


@query("queue_heads", STORE + """
SELECT channel_id, destination_id, arg_min(msg_id, queue_id) AS msg_id, min(queue_id) AS queue_id,
  arg_min(msg_id % 13 = 0, queue_id) AS orphaned, arg_min(ts0 <= TIMESTAMP '1998-01-01', queue_id) AS ready FROM q GROUP BY ALL""")
def queue_heads(spark, sf):
    _, d, q = _store(spark, sf)
    return store.queue_heads(q, d, F.lit("1998-01-01").cast("timestamp")).select(
        "channel_id", "destination_id", "msg_id", "queue_id", "orphaned", "ready")


@query("orphaned_heads", STORE + """
SELECT destination_id, msg_id, (msg_id % 4) + 1 AS attempts FROM (
  SELECT msg_id % 97 AS line, destination_id, arg_min(msg_id, queue_id) AS msg_id FROM q GROUP BY ALL) WHERE msg_id % 13 = 0""")
def orphaned_heads(spark, sf):
    """Ninety-seven lines to each destination, so that some wait on a message whose payload is gone."""
    _, d, q = _store(spark, sf)
    heads = store.queue_heads(q.withColumn("channel_id", (F.col("msg_id") % 97).cast("string")), d, F.lit("1998-01-01").cast("timestamp"))
    return delivery.dead_letter_orphans(heads).select("destination_id", "msg_id", "attempts")


@query("message_detail", STORE + """
SELECT m.msg_id, m.state, string_agg(destination_id || '=' || d.state, ',' ORDER BY destination_id) AS outcomes
FROM m LEFT JOIN d USING (msg_id) GROUP BY ALL""")
def message_detail(spark, sf):
    m, d, _ = _store(spark, sf)
    out = store.message_detail(m.select("msg_id", "state"), d)
    return out.select("msg_id", "state", F.array_join(F.transform(
        "destinations", lambda x: F.concat(x["destination_id"], F.lit("="), x["state"])), ",").alias("outcomes"))


@query("failure_view", STORE + """
SELECT kind, channel_id, count(*) AS n FROM (
  SELECT 'dead_letter' AS kind, channel_id FROM d WHERE state = 'ERROR'
  UNION ALL SELECT CASE WHEN error_text LIKE 'parse (%' THEN 'invalid' ELSE 'pipeline' END, channel_id FROM m WHERE state = 'ERROR') GROUP BY ALL""")
def failure_view(spark, sf):
    m, d, _ = _store(spark, sf)
    return store.failures(m, d.drop("channel_id")).groupBy("kind", "channel_id").agg(F.count("*").alias("n"))


@query("requeue_requests", STORE + """, req AS (SELECT o_orderkey AS msg_id, 'csv' AS destination_id FROM orders WHERE o_custkey % 3 = 0)
SELECT CASE WHEN d.msg_id IS NULL THEN 'no destination' WHEN q.msg_id IS NOT NULL THEN 'already queued' ELSE 'queued' END AS verdict, count(*) AS n
FROM req LEFT JOIN d USING (msg_id, destination_id) LEFT JOIN q USING (msg_id, destination_id) GROUP BY 1""")
def requeue_requests(spark, sf):
    m, d, q = _store(spark, sf)
    req = m.filter(F.col("mrn").cast("long") % 3 == 0).select("msg_id", F.lit("csv").alias("destination_id"))
    return store.requeue(d, q, req).groupBy("verdict").agg(F.count("*").alias("n"))


@query("requeued_destinations", STORE + """
SELECT destination_id, CASE WHEN destination_id = 'csv' AND state = 'ERROR' THEN 'QUEUED' ELSE state END AS state, count(*) AS n,
  CAST(sum(CASE WHEN destination_id = 'csv' AND state = 'ERROR' THEN 0 ELSE attempts END) AS BIGINT) AS attempts FROM d GROUP BY ALL""")
def requeued_destinations(spark, sf):
    _, d, q = _store(spark, sf)
    req = d.filter("destination_id = 'csv' AND dead_letter").select("msg_id", "destination_id")
    return store.apply_requeue(d, store.requeue(d, q, req)).groupBy("destination_id", "state").agg(
        F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


@query("replayed_messages", STORE + """
SELECT 1000000 + row_number() OVER (ORDER BY msg_id) - 1 AS msg_id, msg_id AS replay_of, 'RECEIVED' AS state, md5('O' || msg_id) AS correlation_id,
  msg_id::VARCHAR AS noted FROM m WHERE state = 'ERROR'""")
def replayed_messages(spark, sf):
    m = feeds.stored_messages(spark, sf)
    r = store.replay(m, m.filter("state = 'ERROR'").select("msg_id"), 1_000_000, F.lit("2024-01-01").cast("timestamp"))
    return r.select("msg_id", "replay_of", "state", "correlation_id", F.col("meta")["replay.of"].alias("noted"))


@query("replay_lineage", """
SELECT o_orderkey AS msg_id, o_orderkey % 100 AS original_id FROM orders""")
def replay_lineage(spark, sf):
    """Every message replays the one a hundred earlier."""
    m = feeds.stored_messages(spark, sf).select("msg_id", F.when(F.col("msg_id") >= 100, F.col("msg_id") - 100).alias("replay_of"))
    return chains.lineage(m)


@query("merge_survivors", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 50 < 3 AND c_custkey % 50 >= 0 THEN c_custkey
  WHEN c_custkey % 50 < 10 THEN c_custkey - c_custkey % 50 + 2 ELSE c_custkey - c_custkey % 50 + 10 END AS survivor FROM customer""")
def merge_survivors(spark, sf):
    """Records 0-2 of every fifty merge in a circle, 3-9 lead into it, the
    rest form a chain down to record 10."""
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    k = df.select(m.get("PID-3").cast("long").alias("id"))
    r, base = F.col("id") % 50, F.col("id") - F.col("id") % 50
    n = F.lit(table(spark, sf, "customer").count())
    nxt = F.when(r == 0, base + 1).when(r == 1, base + 2).when(r == 2, base).when(r < 10, F.col("id") - 1).when(r == 10, F.lit(None)).otherwise(F.col("id") - 1)
    return chains.follow(k.withColumn("merged_into", F.when(nxt < n, nxt)), "id", "merged_into")


_EVENTS_LOG = """WITH e AS (SELECT event_id AS seq, ts, user_id AS msg_id, event_id % 2 AS dest, CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'purchase' THEN 'SENT'
  WHEN 'error' THEN 'ERROR' ELSE 'QUEUED' END AS state, CASE WHEN event_type = 'signup' THEN 'p' || event_id END AS payload FROM events)"""


@query("latest_destination_states", _EVENTS_LOG + """
SELECT msg_id, CASE dest WHEN 0 THEN 'csv' ELSE 'fhir' END AS destination_id, arg_max(state, seq) AS state,
  arg_max(payload, seq) FILTER (payload IS NOT NULL) AS payload, arg_max(state, seq) = 'ERROR' AS dead_letter,
  date_trunc('second', max(ts)) AS updated_at, date_trunc('second', max(ts) FILTER (state = 'SENT')) AS sent_at FROM e GROUP BY ALL""")
def latest_destination_states(spark, sf):
    v = feeds.visits(spark, sf)
    t = F.col("trigger")
    log = v.select(
        F.col("seq").alias("event_seq"), "ts", F.substring("visit", 2, 9).cast("long").alias("msg_id"),
        F.when(F.col("seq") % 2 == 0, "csv").otherwise("fhir").alias("destination_id"),
        F.when(t == "A03", "SENT").when(t == "A11", "ERROR").otherwise("QUEUED").alias("state"),
        F.when(t == "A01", F.concat(F.lit("p"), F.substring("control_id", 2, 20))).alias("payload"),
        F.lit(None).cast("string").alias("meta"), F.lit("").alias("error"))
    return store.latest_destinations(log).select("msg_id", "destination_id", "state", "payload", "dead_letter", "updated_at", "sent_at")


_ATTEMPTS = """WITH a AS (SELECT event_id AS seq, 'V' || lpad(user_id::VARCHAR, 9, '0') AS destination_id, day(ts) AS msg_id, date_trunc('second', ts) AS ts,
  CASE event_type WHEN 'error' THEN 'permanent' WHEN 'view' THEN 'transient' ELSE 'sent' END AS outcome FROM events),
n AS (SELECT *, coalesce(sum((outcome = 'transient')::INT) OVER w, 0) AS fb, coalesce(sum((outcome <> 'transient')::INT) OVER w, 0) AS eb FROM a
  WINDOW w AS (PARTITION BY destination_id, msg_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CASE WHEN outcome = 'sent' THEN 'SENT' WHEN outcome = 'permanent' OR fb + 1 >= 3 THEN 'ERROR' ELSE 'QUEUED' END AS verdict
  FROM n WHERE eb = 0 AND fb < 3),
r AS (SELECT destination_id, msg_id, arg_max(verdict, seq) AS state, CAST(sum((outcome <> 'sent')::INT) AS INTEGER) AS attempts, max(seq) AS last_seq,
  min(ts) AS first_at, max(ts) AS last_at FROM c GROUP BY ALL) """


@query("delivery_replay", _ATTEMPTS + """
SELECT destination_id, msg_id, state, attempts, CASE WHEN state = 'SENT' THEN '' ELSE 'attempt E' || last_seq END AS last_error,
  state = 'ERROR' AS dead_letter, CASE WHEN state = 'QUEUED' THEN last_at + INTERVAL 1 SECOND * CAST(5 * pow(2, attempts - 1) AS INTEGER) END AS not_before FROM r""")
def delivery_replay(spark, sf):
    d = delivery.replay_deliveries(feeds.attempts(spark, sf), 3, base=5.0, chunk_rows=1 << 20)
    return d.select("destination_id", "msg_id", "state", "attempts", "last_error", "dead_letter", "not_before")


@query("attempt_backoff", _ATTEMPTS + """
SELECT verdict, CAST(fb + 1 AS INTEGER) AS attempt, count(*) AS n, CASE WHEN verdict = 'QUEUED' THEN least(200.0 * pow(2, fb), 300.0) END AS retry_seconds
FROM c GROUP BY ALL""")
def attempt_backoff(spark, sf):
    log = delivery.attempt_log(feeds.attempts(spark, sf), 3, base=200.0).filter("counted")
    return log.groupBy("verdict", "attempt", "retry_seconds").agg(F.count("*").alias("n"))


@query("delivery_latency", _ATTEMPTS + """
SELECT destination_id, count(*) AS deliveries, count(*) FILTER (state = 'SENT') AS sent, count(*) FILTER (state = 'ERROR') AS dead,
  max(epoch(last_at - first_at)) FILTER (state = 'SENT') AS max_latency,
  quantile_disc(epoch(last_at - first_at), 0.5) FILTER (state = 'SENT') AS median_latency FROM r GROUP BY 1""")
def delivery_latency(spark, sf):
    return delivery.latency(delivery.replay_deliveries(feeds.attempts(spark, sf), 3))


# ---- captures -------------------------------------------------------------

@query("mllp_captures", """
SELECT c_custkey AS conn, CASE WHEN c_custkey % 97 = 0 THEN 1 WHEN c_custkey % 97 = 1 THEN 0 ELSE 2 END AS frames,
  CASE WHEN c_custkey % 97 = 0 THEN 'mllp: expected frame start 0x0B, got 0x58' WHEN c_custkey % 97 = 1 THEN 'unexpected EOF' END AS error,
  CASE WHEN c_custkey % 97 = 1 THEN 0 WHEN c_custkey % 97 = 0 THEN 1 ELSE 2 END * c_custkey AS mrn_sum FROM customer""")
def mllp_captures(spark, sf):
    """Two frames per connection; some captures hold a stray byte, some end early."""
    c = feeds.customers_hl7(spark, sf)
    k, one = F.col("msg_id"), captures.frame_mllp(F.col("raw"))
    stray = F.when(k % 97 == 0, F.unhex(F.lit("58"))).otherwise(F.unhex(F.lit("")))
    whole = F.concat(one, stray, one)
    cap = F.when(k % 97 == 1, F.call_function("substring", one, F.lit(1), F.length(one) - 3)).otherwise(whole)
    got = captures.deframe_mllp(c.select(k.alias("conn"), cap.alias("capture")), ["conn"])
    df, m = parsed_hl7(got)
    return df.groupBy("conn").agg(F.count_if(F.col("error").isNull()).alias("frames"), F.max("error").alias("error"),
                                  F.coalesce(F.sum(m.get("PID-3").cast("long")), F.lit(0)).alias("mrn_sum"))


def _astm_orders(spark, sf):
    o = table(spark, sf, "orders")
    b = new_message("astm").set("H-5", "LIS").set("H-14", "20240101").set("O-1", "1").set("O-2", F.col("o_orderkey"))
    b.set("O-4.4", F.repeat(F.col("o_orderpriority"), 40)).set("L-1", "1").set("L-2", "N")
    return o.select(F.col("o_orderkey").alias("conn"), b.text().alias("raw"))


@query("e1381_frames", """
SELECT o_orderpriority AS priority, CAST(sum(2 + ceil(len / 240.0)) AS BIGINT) AS frames, CAST(sum(2 + ceil(len / 240.0)) AS BIGINT) AS valid,
  CAST(sum(len + 37) AS BIGINT) AS bytes
FROM (SELECT o_orderpriority, 8 + length(o_orderkey::VARCHAR) + length(o_orderpriority) * 40 AS len FROM orders) GROUP BY 1""")
def e1381_frames(spark, sf):
    f = captures.frame_e1381(_astm_orders(spark, sf).join(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("conn"), "o_orderpriority"), "conn"), ["conn", "o_orderpriority"])
    g = captures.deframe_e1381(f.select("conn", "o_orderpriority", "frame"))
    return g.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count("*").alias("frames"), F.count_if(F.col("error").isNull()).alias("valid"), F.sum(F.length("text")).alias("bytes"))


@query("e1381_assembly", """
SELECT o_orderkey AS conn, CASE WHEN o_orderkey % 7 = 3 THEN 0 ELSE 1 END AS messages, CASE WHEN o_orderkey % 7 <> 3 THEN o_orderpriority END AS test,
  CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 <> 3 THEN 1 ELSE 0 END AS duplicates,
  CASE WHEN o_orderkey % 7 = 3 THEN 'astm1381: expected STX, got 0x58' WHEN o_orderkey % 7 = 4 THEN 'frame outside a session' END AS ended FROM orders""")
def e1381_assembly(spark, sf):
    """Frames of every order as one capture.

    The second frame is sent again on some; on some a stray byte before it ends the connection, on some a frame comes
    after the session's end, and what follows in a new session is not heard any more."""
    f = captures.frame_e1381(_astm_orders(spark, sf), ["conn"])
    again = F.when((F.col("conn") % 5 == 0) & (F.col("idx") == 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    f = captures.deframe_e1381(f.select("*", F.explode(again).alias("copy")).drop("number", "text", "last"))
    k = F.col("conn")
    at = k * 1000 + F.col("idx") * 2 + F.col("copy")
    once = (k % 7 == 4) & ((at - k * 1000) % 2 == 0)
    arrivals = F.concat(F.array(at), F.array_compact(F.array(F.when(once & (at == k * 1000 + 2), k * 1000 + 901), F.when(once, at + 902))))
    data = f.select("conn", F.explode(arrivals).alias("arrival"), F.lit(None).cast("string").alias("signal"), "number", "text", "last", "error")
    row = lambda at, signal, error=None: F.struct(at.alias("arrival"), F.lit(signal).cast("string").alias("signal"), F.lit(error).cast("string").alias("error"))
    others = F.array_compact(F.array(
        F.when(k % 7 == 3, row(k * 1000 + 3, None, "astm1381: expected STX, got 0x58")),
        F.when(k % 7 == 4, row(k * 1000 + 900, captures.EOT)), F.when(k % 7 == 4, row(k * 1000 + 902, captures.ENQ))))
    marks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("conn")).select(
        "conn", F.explode(F.concat(F.array(row(k * 1000, captures.ENQ)), others)).alias("x")).select(
        "conn", "x.arrival", "x.signal", *(F.lit(None).cast(t).alias(n) for n, t in (("number", "string"), ("text", "string"), ("last", "boolean"))), "x.error")
    every = data.unionByName(marks)
    got = captures.assemble_e1381(every.withColumn("conn", F.col("conn").cast("string")))
    df, a = parse_delimited(got, ASTM), Parsed("msg", ASTM)
    return df.groupBy(F.col("conn").cast("long").alias("conn")).agg(
        F.count_if(F.col("raw").isNotNull()).cast("int").alias("messages"),
        F.max(F.call_function("substring", a.get("O-4.4"), F.lit(1), (F.length(a.get("O-4.4")) / 40).cast("int"))).alias("test"),
        F.count_if(F.col("note") == "duplicate").cast("int").alias("duplicates"),
        F.max(F.when(~F.col("note").startswith("nak") & (F.col("note") != "duplicate"), F.col("note"))).alias("ended"))


@query("acknowledgements", """
SELECT coalesce(code, 'none') AS code, outcome, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'AR'
  WHEN c_custkey % 10 = 2 THEN 'AE' ELSE 'AA' END AS code, CASE WHEN c_custkey % 10 = 0 THEN 'transient' WHEN c_custkey % 10 IN (1, 2) THEN 'permanent' ELSE 'sent' END AS outcome
  FROM customer) GROUP BY ALL""")
def acknowledgements(spark, sf):
    """ACKs built for most messages, read back and matched to them."""
    df, m = parsed_hl7(feeds.customers_hl7(spark, sf))
    k = F.col("msg_id")
    code = F.when(k % 10 == 1, "AR").when(k % 10 == 2, "AE").otherwise("AA")
    acks = df.filter(k % 10 != 0).select(tr.ack(m, code, F.lit("text & more"), F.concat(F.lit("K"), k.cast("string")),
                                                F.lit("2024-01-01").cast("timestamp")).alias("raw"))
    adf, am = parsed_hl7(acks)
    read = adf.select(*(c.alias(n) for n, c in tr.read_ack(am).items()))
    from ..operators.feeds import match_acks
    sent = df.select(m.get("MSH-10").alias("control_id"))
    got = match_acks(sent, read.filter((F.col("text") == "text & more") & F.col("error").isNull()))
    return got.withColumn("outcome", outcome.mllp_outcome(F.col("code"))).groupBy(
        F.coalesce("code", F.lit("none")).alias("code"), "outcome").agg(F.count("*").alias("n"))


@query("http_requests", """
SELECT status, count(*) AS n, count(q) AS with_query, CAST(sum(k) AS BIGINT) AS k_sum FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 11 = 1 THEN 401
  WHEN event_id % 11 = 2 THEN 405 WHEN event_id % 11 = 3 THEN 400 ELSE 0 END AS status, event_type AS q, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def http_requests(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id") % 11
    kv = F.get_json_object("props", "$.k")
    req = e.select(F.when(i == 2, "GET").otherwise("POST").alias("method"), F.when(i == 0, "/other").otherwise("/in").alias("url_path"),
                   F.concat(F.lit("t="), F.col("event_type"), F.lit("&t=second&k="), kv).alias("query"),
                   F.lit("application/json").alias("content_type"), F.lit("10.0.0.1:1").alias("remote"), (i != 1).alias("auth"),
                   F.when(i == 3, "").otherwise(F.col("props")).alias("body"))
    got = captures.ingest_http(req, "/in", authorized=F.col("auth"))
    meta = F.col("meta")
    return got.groupBy(F.coalesce("refused", F.lit(0)).alias("status")).agg(
        F.count("*").alias("n"), F.count_if(meta["source.http.query.t"] != "second").alias("with_query"),
        F.sum(meta["source.http.query.k"].cast("long")).alias("k_sum"))


@query("recorded_messages", """
SELECT count(*) AS n, count(*) AS distinct_ids, CAST(min(1) AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS received,
  count(DISTINCT md5('crm' || chr(31) || c_custkey)) AS correlations FROM customer""")
def recorded_messages(spark, sf):
    """Fresh messages stamped and numbered 1..n without a global sort."""
    c = feeds.customers_hl7(spark, sf).withColumnRenamed("msg_id", "key").withColumns({
        "source": F.lit("crm"), "at": F.lit("2024-01-01").cast("timestamp")})
    r = store.record(c, "crm", "hl7v2", ["source", "key"], "at")
    return r.agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("distinct_ids"), F.min("msg_id").alias("first_id"),
                 F.max("msg_id").alias("last_id"), F.count_if(F.col("state") == "RECEIVED").alias("received"),
                 F.count_distinct("correlation_id").alias("correlations"))


@query("stage_payloads", STORE + """
SELECT 'received' AS stage, count(*) AS n FROM m UNION ALL SELECT 'dest:csv', count(*) FROM d WHERE destination_id = 'csv' AND msg_id % 13 <> 0""")
def stage_payloads(spark, sf):
    """Payloads of two stages, parsed to trees."""
    m, d, _ = _store(spark, sf)
    out = None
    for stage in ("received", "dest:csv"):
        df, p = parsed_hl7(store.stage_payload(m, d, stage).withColumnRenamed("payload", "raw"))
        one = df.filter(p.get("PID-3") != "").agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("manifest_messages", """
SELECT c_custkey - (SELECT min(c_custkey) FROM customer) + 1 AS seq, c_custkey // 400 AS part, 'C' || c_custkey AS control_id, c_name AS family, 'crm' AS feed FROM customer""")
def manifest_messages(spark, sf):
    """A corpus written in parts; each message is cut from its part by what the manifest says, and parsed."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.files import corpus_messages, write_corpus
    c = feeds.customers_hl7(spark, sf).select("msg_id", "raw", F.lit("crm").alias("feed"), F.concat(F.lit("C"), F.col("msg_id").cast("string")).alias("control_id"))
    path = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    write_corpus(c, path, part_rows=400)
    df, m = parsed_hl7(corpus_messages(spark, path).withColumnRenamed("raw", "bytes").withColumn("raw", F.col("bytes").cast("string")))
    # the message itself must be the one that the manifest names
    return df.filter(m.get("MSH-10") == F.col("controlId")).select("seq", "part", m.get("MSH-10").alias("control_id"), m.get("PID-5.1").alias("family"), "feed")


@query("state_change_feed", """
SELECT 'message' AS type, count(*) AS n FROM events WHERE event_id % 2 = 0 AND event_id >= 100 UNION ALL SELECT 'resync', 1""")
def state_change_feed(spark, sf):
    """A consumer far behind a trimmed log: one resync row, then the changes."""
    from ..streaming.intake import changes_since
    v = feeds.visits(spark, sf).filter("seq >= 100")
    log = v.select(F.col("seq").alias("event_seq"), F.when(F.col("seq") % 2 == 0, "even").otherwise("odd").alias("channel_id"),
                   F.col("seq").alias("msg_id"), F.lit("SENT").alias("state"))
    return changes_since(log, 10, "even").groupBy("type").agg(F.count("*").alias("n"))


@query("legacy_charsets", """
SELECT c_custkey AS msg_id, c_name || ' é' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '€' END AS text FROM customer""")
def legacy_charsets(spark, sf):
    """XML declared ISO-8859-1 or Windows-1252, read as text and re-declared."""
    from ..functions.trees import Tree, parse_tree
    c = table(spark, sf, "customer")
    odd = F.col("c_custkey") % 2 == 1
    label = F.when(odd, "windows-1252").otherwise("ISO-8859-1")
    raw = F.concat(F.concat(F.lit('<?xml version="1.0" encoding="'), label, F.lit('"?><a>'), F.col("c_name"), F.lit(" ")).cast("binary"),
                   F.unhex(F.lit("E9")), F.when(odd, F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit(""))), F.lit("</a>").cast("binary"))
    df, t = parse_tree(c.select(F.col("c_custkey").alias("msg_id"), raw.alias("raw")), "xml"), Tree("msg", "xml")
    return df.filter(F.contains(t.serialize(), F.lit('encoding="UTF-8"'))).select("msg_id", t.get("a").alias("text"))
