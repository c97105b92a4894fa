"""Store, delivery, capture, window and channel operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from segmenta.functions import outcome, scalars as sc
from segmenta.functions.delimited import HL7V2, Parsed, parse_delimited
from segmenta.operators import chains, chunked, delivery, feeds, store
from segmenta.plans import translators as tr
from segmenta.plans.channel import Channel, Destination, run_channel, seconds_of
from segmenta.sources import captures, files
from segmenta.streaming import intake, stateful, windows
from segmenta.workload import QUERIES, SQL

T0 = dt.datetime(2024, 1, 1)


def test_running_matches_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaab"), i, rng.randint(0, 9) if rng.random() < .7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    for chunk in (7, 1000):
        got = chunked.running(df, ["k"], ["seq"], chunked.id_chunk(F.col("seq"), chunk), s=("sum", F.col("v")), m=("max", F.col("v")),
                              p=("last", F.col("v")), n=("next", F.col("v")))
        want = []
        for k, seq, v in rows:
            before = [x[2] for x in rows if x[0] == k and x[1] < seq and x[2] is not None]
            after = [x[2] for x in rows if x[0] == k and x[1] > seq and x[2] is not None]
            want.append((k, seq, v, sum(before), max(before, default=None), before[-1] if before else None, after[0] if after else None))
        assert [tuple(r) for r in got.orderBy("seq").collect()] == want
    order = chunked.numbered(df, [], ["seq"], chunked.id_chunk(F.col("seq"), 11)).orderBy("seq")
    assert [r.rn for r in order.collect()] == list(range(1, 301))


def test_chains_with_cycles(spark):
    links = {1: 2, 2: 3, 3: None, 4: 5, 5: 6, 6: 4, 7: 4, 8: 7, 9: 9, 10: 3}
    df = spark.createDataFrame(list(links.items()), "id long, nxt long")

    def survivor(p):
        seen = set()
        while links[p] is not None and p not in seen:
            seen.add(p)
            p = links[p]
        return p

    got = {r.id: r.survivor for r in chains.follow(df, "id", "nxt").collect()}
    assert got == {p: survivor(p) for p in links}


def test_chain_rounds_shrink(spark):
    """A long chain, many short ones and a ring: later rounds look at what is open alone, and the ring at itself."""
    links = {i: i - 1 for i in range(1, 300)} | {0: None} | {1000 + i: 1000 + i // 3 * 3 for i in range(600) if i % 3} | {1000 + i: None for i in range(0, 600, 3)}
    links |= {5000 + i: 5000 + (i + 1) % 7 for i in range(7)} | {6000: 5003, 6001: 6000}
    rounds = []
    got = {r.id: r.survivor for r in chains.follow(spark.createDataFrame(list(links.items()), "id long, nxt long"), "id", "nxt", rounds.append).collect()}
    want = {i: 0 for i in range(300)} | {1000 + i: 1000 + i // 3 * 3 for i in range(600)} | {5000 + i: 5000 + i for i in range(7)} | {6000: 5003, 6001: 5003}
    assert got == want
    first = rounds[:rounds.index(9) + 1]  # 9 records lead into the ring
    assert first[0] == 299 + 400 + 9 and all(a > b for a, b in zip(first, first[1:])) and first[1] < first[0] / 2 and len(rounds) < 16


def test_retention_keeps_queued(spark):
    m = spark.createDataFrame([(i, "a") for i in range(1, 11)] + [(i, "b") for i in range(11, 14)], "msg_id long, channel_id string")
    q = spark.createDataFrame([("a", 2)], "channel_id string, msg_id long")
    assert sorted(r.msg_id for r in store.retained(m, q, 3).collect()) == [2, 8, 9, 10, 11, 12, 13]
    assert sorted(r.msg_id for r in store.pruned(m, q, 3).collect()) == [1, 3, 4, 5, 6, 7]
    assert store.retained(m, q, -1).count() == 13


def test_latest_destination_keeps_payload(spark):
    e = spark.createDataFrame([(1, T0, 1, "d", "QUEUED", "p", None, ""), (2, T0, 1, "d", "ERROR", None, None, "boom"), (3, T0, 1, "d", "SENT", None, "m", "")],
                              "event_seq long, ts timestamp, msg_id long, destination_id string, state string, payload string, meta string, error string")
    r = store.latest_destinations(e).first()
    assert (r.state, r.payload, r.meta, r.last_error, r.dead_letter, r.queued_at, r.sent_at) == ("SENT", "p", "m", "", False, T0, T0)


ATTEMPTS = [("d", 1, 1, "transient"), ("d", 1, 2, "sent"), ("d", 1, 3, "transient"), ("d", 2, 4, "permanent"), ("d", 3, 5, "transient"),
            ("d", 3, 6, "transient"), ("d", 3, 7, "transient"), ("d", 3, 8, "sent"), ("e", 1, 9, "transient")]


def _attempts(spark):
    return spark.createDataFrame([(d, m, s, T0 + dt.timedelta(seconds=s), o, f"e{s}") for d, m, s, o in ATTEMPTS],
                                 "destination_id string, msg_id long, attempt_seq long, ts timestamp, outcome string, error string")


WANT = {("d", 1): ("SENT", 1, ""), ("d", 2): ("ERROR", 1, "e4"), ("d", 3): ("ERROR", 3, "e7"), ("e", 1): ("QUEUED", 1, "e9")}


def test_delivery_batch_and_stream_agree(spark, tmp_path):
    got = delivery.replay_deliveries(_attempts(spark), 3, chunk_rows=2)
    assert {(r.destination_id, r.msg_id): (r.state, r.attempts, r.last_error) for r in got.collect()} == WANT
    src = str(tmp_path / "in")
    a = _attempts(spark)
    for lo, hi in ((1, 4), (5, 9)):  # two runs from one checkpoint
        a.filter(F.col("attempt_seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        stream = stateful.deliver(spark.readStream.schema(a.schema).parquet(src), 3)
        out = str(tmp_path / "out")
        q = stream.writeStream.outputMode("update").foreachBatch(
            lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = feeds.latest_per(rows, ["destination_id", "msg_id"], ["batch", "last_seq"], ["state", "attempts", "last_error"])
    assert {(r.destination_id, r.msg_id): (r.state, r.attempts, r.last_error) for r in last.collect()} == WANT


def test_backoff_table(spark):
    n = spark.createDataFrame([(1,), (2,), (3,), (10,), (50,)], "n int")
    assert [r[0] for r in n.select(outcome.backoff_seconds(F.col("n"), 1.0)).collect()] == [1, 2, 4, 300, 300]
    for r in n.select(outcome.backoff_seconds(F.col("n"), 1.0), outcome.backoff_seconds(F.col("n"), 1.0, jitter_key=[F.col("n")])).collect():
        assert 0.8 * r[0] <= r[1] <= 1.2 * r[0]


def test_captures(spark):
    vt, fs = b"\x0b", b"\x1c\r"
    caps = [vt + b"a" + fs + vt + b"b" + fs, vt + b"a" + fs + b"x" + vt + b"b" + fs, vt + b"a" + b"\x1cZ", vt + b"a", b"", vt + b"a" + fs + vt + b"abcdefghijk" + fs, b"x"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(caps)], "id int, capture binary")
    got = {}
    for r in captures.deframe_mllp(df, ["id"], max_size=5).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.error if r.error else bytes(r.raw))
    assert got == {0: [b"a", b"b"], 1: [b"a", "mllp: expected frame start 0x0B, got 0x78"], 2: ["mllp: expected CR after frame end, got 0x5A"],
                   3: ["unexpected EOF"], 5: [b"a", "mllp: message exceeds maximum size 5"], 6: ["mllp: expected frame start 0x0B, got 0x78"]}
    msg = b"H|\\^&\rP|1\r" + b"R|" + b"x" * 500 + b"\rL|1|N\r"
    f = captures.frame_e1381(spark.createDataFrame([("c", bytearray(msg))], "conn string, raw binary"), ["conn"])
    rows = f.orderBy("idx").collect()
    assert [r.number for r in rows] == ["1", "2", "3", "4", "5", "6"] and [r["last"] for r in rows] == [False] * 5 + [True]
    assert bytes(rows[0].frame) == b"\x021H|\\^&\r\x17" + b"%02X" % (sum(b"1H|\\^&\r\x17") % 256) + b"\r\n"
    broken = bytearray(rows[1].frame)
    broken[3] ^= 1
    stream = [("c", 0, captures.ENQ, None), ("c", 1, None, rows[0].frame), ("c", 2, None, broken), ("c", 3, None, rows[1].frame), ("c", 4, None, rows[1].frame)]
    stream += [("c", 5 + i, None, r.frame) for i, r in enumerate(rows[2:])] + [("c", 20, captures.EOT, None), ("c", 21, None, rows[0].frame)]
    s = captures.deframe_e1381(spark.createDataFrame(stream, "conn string, arrival long, signal string, frame binary"))
    s = s.withColumn("error", F.when(F.col("frame").isNotNull(), F.col("error")))
    out = captures.assemble_e1381(s.select("conn", "arrival", "signal", "number", "text", "last", "error")).orderBy("session", "first_arrival").collect()
    assert [bytes(r.raw) for r in out if r.raw is not None] == [msg]
    assert sorted(r.note.split(":")[0] for r in out if r.note) == ["duplicate", "frame outside a session", "nak"]
    # bytes that are no frame end the connection; a foreign number does not; a message over the limit is only noted
    good = [("c", 1, None, rows[0].frame), ("c", 9, None, bytearray(b"\x58")), ("d", 1, None, rows[0].frame), ("d", 2, None, rows[3].frame)]
    good += [("c", 10 + i, None, r.frame) for i, r in enumerate(rows[1:])] + [("d", 10 + i, None, r.frame) for i, r in enumerate(rows[1:])]
    s = captures.deframe_e1381(spark.createDataFrame([("c", 0, captures.ENQ, None), ("d", 0, captures.ENQ, None), *good], "conn string, arrival long, signal string, frame binary"))
    s = s.withColumn("error", F.when(F.col("frame").isNotNull(), F.col("error"))).select("conn", "arrival", "signal", "number", "text", "last", "error")
    out = captures.assemble_e1381(s).collect()
    assert [(r.conn, bytes(r.raw)) for r in out if r.raw is not None] == [("d", msg)]
    assert sorted((r.conn, r.note) for r in out if r.note) == [("c", "astm1381: expected STX, got 0x58"), ("d", "nak: wrong frame number")]
    assert {r.note for r in captures.assemble_e1381(s, max_message=10).collect() if r.conn == "d"} == {"message too large", "nak: wrong frame number"}


def test_acks(spark):
    raw = "MSH|^~\\&|S|SF|R|RF|1||ADT^A01|C1|T|2.3\rPID|1\r"
    df = parse_delimited(spark.createDataFrame([(raw,), ("junk",)], "raw string"), HL7V2)
    m = Parsed("msg", HL7V2)
    got = [r[0] for r in df.select(tr.ack(m, F.lit("AA"), F.lit("a|b"), F.lit("K"), F.lit(T0))).collect()]
    assert got[0] == "MSH|^~\\&|R|RF|S|SF|20240101000000||ACK^A01^ACK|K|T|2.3\rMSA|AA|C1|a\\F\\b\r"
    assert got[1] == "MSH|^~\\&|||||20240101000000||ACK|K|P|2.5.1\rMSA|AA||a\\F\\b\r"


def test_channel_rules(spark):
    ok = dict(id="c", source="file-reader", data_type="hl7v2", destinations=[dict(id="d", adapter="file-writer")])
    assert Channel.from_dict(ok).destinations[0].data_type == "hl7v2"
    for change in (dict(id=""), dict(source="x"), dict(data_type="x"), dict(destinations=[]), dict(retention=0), dict(typo=1),
                   dict(destinations=[dict(id="d", adapter="file-writer")] * 2), dict(destinations=[dict(id="d", adapter="file-writer", max_attempts=0)])):
        with pytest.raises(ValueError):
            Channel.from_dict({**ok, **change})
    assert seconds_of("1m30s") == 90 and seconds_of("250ms") == 0.25
    for bad in (30, "30", "-1s", "x"):
        with pytest.raises(ValueError):
            seconds_of(bad)


def _channel():
    def translate(m):
        m.set_meta("seen", "yes")
        m.delete_meta("drop")
        m.reject(m.get("PID-5.1") == "BAD", "AE", "bad name")
        return m.set("PID-5.1", F.upper(m.get("PID-5.1")))

    return Channel("c", "file-reader", "hl7v2", [Destination("csv", "file-writer", "csv", transformers=[tr.patient_csv]), Destination("raw", "file-writer")],
                   filter=lambda m: m.get("MSH-9.1") == "ADT", transformers=[translate])


def _messages(spark):
    msg = lambda kind, name: f"MSH|^~\\&|A||||1||{kind}^A01|1|P|2.5\rPID|1||7||{name}^J\r"
    rows = [(1, msg("ADT", "doe"), {"drop": "x"}), (2, msg("ORU", "doe"), {}), (3, msg("ADT", "BAD"), {"drop": "x"}), (4, "junk", {})]
    return spark.createDataFrame(rows, "msg_id long, raw string, meta map<string,string>")


def test_channel_outcomes(spark):
    m, d = run_channel(_channel(), _messages(spark))
    got = {r.msg_id: r for r in m.collect()}
    assert [(got[i].state, got[i].ack_code) for i in (1, 2, 3, 4)] == [("TRANSFORMED", "AA"), ("FILTERED", "AA"), ("ERROR", "AE"), ("ERROR", "AE")]
    assert got[1].meta == {"seen": "yes"} and got[3].meta == {"drop": "x"}
    assert got[3].error_text == "translator 1: rejected (AE): bad name" and got[4].error_text.startswith("parse (hl7v2): ")
    out = {r.destination_id: (r.state, bytes(r.payload).decode(), r.meta["destination.id"]) for r in d.collect()}
    assert out["csv"] == ("QUEUED", "7,DOE,J,\n", "csv") and out["raw"][1].endswith("PID|1||7||DOE^J\r")


def test_channel_stream_survives_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = _messages(spark)
    for lo, hi in ((1, 2), (3, 4)):
        rows.filter(F.col("msg_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        intake.start_channel(spark.readStream.schema(rows.schema).parquet(src), _channel(), out, cp, available_now=True).awaitTermination()
    got = spark.read.parquet(f"{out}/messages")
    assert sorted((r.msg_id, r.state) for r in got.collect()) == [(1, "TRANSFORMED"), (2, "FILTERED"), (3, "ERROR"), (4, "ERROR")]
    assert spark.read.parquet(f"{out}/deliveries").count() == 2


def test_alert_stream_matches_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["v1", "v2", "v3"]), i, T0 + dt.timedelta(seconds=rng.choice([i, i, i - 50])), rng.choice(["A01", "A02", "A03", "A08", "A11"]))
            for i in range(120)]
    e = spark.createDataFrame(rows, "visit string, seq long, ts timestamp, trigger string")
    want = sorted(tuple(r) for r in feeds.lifecycle_breaches(e, chunk_rows=13).collect())
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    q = stateful.lifecycle_alerts(spark.readStream.schema(e.schema).parquet(src)).writeStream.format("memory").queryName("alerts").outputMode(
        "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("alerts").collect()) == want and want


def test_hold_and_dedupe_streams(spark, tmp_path):
    m = spark.createDataFrame([("a", T0), ("b", T0), ("z", T0 + dt.timedelta(hours=5))], "control_id string, ts timestamp")
    o = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=5), "AA"), ("q", T0 + dt.timedelta(hours=5), "AA")], "refers_to string, answered_at timestamp, code string")
    m.coalesce(1).write.parquet(str(tmp_path / "m"))
    o.coalesce(1).write.parquet(str(tmp_path / "o"))
    s = intake.hold_for_outcome(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), spark.readStream.schema(o.schema).parquet(str(tmp_path / "o")), "30 seconds")
    q = s.writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.control_id: r.code for r in spark.table("held").collect()}
    assert got["a"] == "AA" and "z" not in got
    # once rows of a later hour have moved the watermark, what was never answered comes out with NULL
    more = m.limit(0).union(spark.createDataFrame([("y", T0 + dt.timedelta(hours=9))], m.schema))
    later = o.limit(0).union(spark.createDataFrame([("x", T0 + dt.timedelta(hours=9), "AA")], o.schema))
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    held = intake.hold_for_outcome(spark.readStream.schema(m.schema).parquet(str(tmp_path / "m")), spark.readStream.schema(o.schema).parquet(str(tmp_path / "o")), "30 seconds")
    q = held.writeStream.format("parquet").option("path", str(tmp_path / "answers")).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    answers = {r.control_id: r.code for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert answers["a"] == "AA" and answers["b"] is None and "b" in answers
    dup = m.union(m)
    dup.coalesce(1).write.parquet(str(tmp_path / "d"))
    q = intake.dedupe_resends(spark.readStream.schema(m.schema).parquet(str(tmp_path / "d"))).writeStream.format("memory").queryName("once").option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3


def test_late_rows_and_resync(spark, tmp_path):
    fn = intake.late_side_table(str(tmp_path / "ok"), str(tmp_path / "late"), "1 minute")
    row = lambda *s: spark.createDataFrame([(T0 + dt.timedelta(seconds=x),) for x in s], "ts timestamp")
    fn(row(0, 600), 0)
    fn(row(100, 590), 1)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3 and spark.read.parquet(str(tmp_path / "late")).count() == 1
    e = spark.createDataFrame([(5, "a", 1, "SENT"), (6, "b", 2, "SENT")], "event_seq long, channel_id string, msg_id long, state string")
    assert sorted((r.event_seq, r.type) for r in intake.changes_since(e, 2, "a").collect()) == [(4, "resync"), (5, "message")]
    assert intake.count_only(e) == 2 and windows.tumbling(row(0, 1, 3700), "1 hour").count() == 2


def test_relative_urls(spark):
    from urllib.parse import urljoin
    base = "http://h/base/dir/"
    paths = ["a", "a/../b", "../x", "/y/./z", "../../..", "./", "..", "a/b/..", "?q=../1", "a/../b?c=/../d", "", "/", "x/.", "#f", "/a/b/../../../c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.u for r in df.select("p", outcome.resolve_url(base, F.col("p")).alias("u")).collect()}
    assert got == {p: urljoin(base, p) for p in paths}


def test_late_marks_need_their_folder(spark, tmp_path):
    """A batch that is run again splits as it did before, and a failed read is not taken for a first batch."""
    fn = intake.late_side_table(str(tmp_path / "ok"), str(tmp_path / "late"), "1 minute")
    row = lambda *s: spark.createDataFrame([(T0 + dt.timedelta(seconds=x),) for x in s], "ts timestamp")
    fn(row(0, 600), 0)
    for _ in range(2):
        fn(row(100, 590, 700), 1)
    fn(row(620), 2)
    late = sorted((r.batch, int((r.ts - T0).total_seconds())) for r in spark.read.parquet(str(tmp_path / "late")).collect())
    assert late == [(1, 100), (2, 620)]
    (tmp_path / "late_marks" / "batch=2" / "broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        fn(row(800), 3)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b x.hl7").write_bytes(b"MSH|^~\\&|A\r")
    (tmp_path / "in" / "skip.txt").write_bytes(b"no")
    got = files.read_message_files(spark, str(tmp_path / "in"), "*.hl7", "0 seconds").collect()
    assert [(r.meta["source.file"], bytes(r.raw)) for r in got] == [("b x.hl7", b"MSH|^~\\&|A\r")]
    stream = files.stream_message_files(spark, str(tmp_path / "in"), "*.hl7").writeStream.format("memory").queryName("intake").option(
        "checkpointLocation", str(tmp_path / "cpi")).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("intake").count() == 1
    rows = [(i, f"MSH|^~\\&|A|{'x' * i}\rPID|{i}\r", "adt", "ADT^A01", f"C{i}", T0) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "msg_id long, raw string, feed string, trigger string, control_id string, ts timestamp")
    files.write_corpus(df, str(tmp_path / "corpus"))
    back = files.read_corpus(spark, str(tmp_path / "corpus" / "messages"))
    assert sorted(r.raw for r in back.collect()) == sorted(r[1] for r in rows)
    man = files.read_corpus_manifest(spark, str(tmp_path / "corpus" / "manifest")).orderBy("seq").collect()
    want, at = [], 0
    for i, r in enumerate(rows, 1):
        want.append((i, r[4], at, len(r[1])))
        at += len(r[1])
    assert [(r.seq, r.controlId, r.offset, r.length) for r in man] == want
    files.write_append_csv(spark.createDataFrame([("a,b", 'q"x')], "x string, y string"), str(tmp_path / "csv"))
    # several parts: every message is cut from its own part, whatever is asked for
    files.write_corpus(df.drop("feed"), str(tmp_path / "parts"), part_rows=3)
    man = files.read_corpus_manifest(spark, str(tmp_path / "parts" / "manifest"))
    assert sorted((r.seq, r.part, r.offset) for r in man.collect())[2:4] == [(3, 1, 0), (4, 1, len(rows[2][1]))] and {r.feed for r in man.collect()} == {None}
    got = files.corpus_messages(spark, str(tmp_path / "parts")).collect()
    assert sorted((r.seq, bytes(r.raw).decode()) for r in got) == [(i, r[1]) for i, r in enumerate(rows, 1)]
    some = files.corpus_messages(spark, str(tmp_path / "parts"), man.filter("seq in (2, 7)").withColumn("length", F.when(F.col("seq") == 7, 10_000).otherwise(F.col("length"))))
    assert sorted((r.seq, r.raw and bytes(r.raw).decode()) for r in some.collect()) == [(2, rows[1][1]), (7, None)]
    assert [tuple(r) for r in files.read_csv_rows(spark, str(tmp_path / "csv"), 2, header=True).collect()] == [("a,b", 'q"x', [])]
    (tmp_path / "wide.csv").write_text("a,b,c\nd\ne,\nf,g,h,i\n")
    assert [tuple(r) for r in files.read_csv_rows(spark, str(tmp_path / "wide.csv"), 2).collect()] == [
        ("a", "b", ["c"]), ("d", None, []), ("e", "", []), ("f", "g", ["h", "i"])]


def test_value_text(spark):
    vals = [0.0, -0.0, 1.0, 1.5, 1e5, 123456789.0, 1e20, 1e21, 1.5e-5, 0.0001, -2.25, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(sc.value_text(F.col("v"), "double")).collect()]
    assert got == ["0", "-0", "1", "1.5", "100000", "123456789", "100000000000000000000", "1e+21", "1.5e-05", "0.0001", "-2.25", ""]


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 90


def test_sessions_of_one_hot_key(spark, monkeypatch):
    """One key, thousands of slices, chunks of a few: the same as a plain scan, and no option of the session changes."""
    import random

    from segmenta.streaming import windows

    monkeypatch.setattr(windows, "SLICES", 3)
    rng, at, rows = random.Random(3), 0, []
    for i in range(4000):
        at += rng.choice([0, 1, 59, 60, 61, 600])
        rows.append(("hot" if i % 3 else "cold", at))
    rows += [(None, 5), (None, 70), ("odd", None)]
    df = spark.createDataFrame([(k, None if t is None else T0 + dt.timedelta(seconds=t)) for k, t in rows], "k string, ts timestamp").repartition(4)
    want = []
    for key in ("hot", "cold", None):
        times = sorted(t for k, t in rows if k == key and t is not None)
        begin = last = times[0]
        n = 0
        for t in times + [10 ** 9]:
            if t - last >= 60 and n:
                want.append((key, begin, last + 60, n))
                begin, n = t, 0
            last, n = t, n + 1
    option = "spark.sql.sessionWindow.merge.sessions.in.local.partition"
    spark.conf.unset(option)
    got = windows.sessions(df, "1 minute", "k").collect()
    secs = lambda t: int((t - T0).total_seconds())
    assert sorted(((r.k, secs(r.start), secs(r.end), r.n) for r in got), key=str) == sorted(want, key=str)
    assert spark.conf.get(option, "unset") == "unset"


def test_bed_map_on_a_stream(spark, tmp_path):
    """Late acts within the lateness are put in their place, also over a restart; free beds lose their state."""
    from segmenta.streaming import beds

    own = beds.state_session(spark)
    schema = "visit string, seq long, ts timestamp, trigger string, location string, prior string"
    row = lambda seq, visit, trigger, location, prior="", at=None: (visit, seq, T0 + dt.timedelta(minutes=seq if at is None else at), trigger, location, prior)
    rows = [row(1, "a", "A01", "b1"), row(2, "b", "A01", "b2"), row(4, "a", "A02", "b3", "b1"), row(6, "c", "A01", "b1"), row(9, "b", "A03", "b2"), row(7, "c", "A02", "b2", "b1"),
            row(8, "x", "A03", "b3"), row(12, "d", "A01", "b1"), row(5, "e", "A01", "b4"), row(13, "e", "A03", "b4"), row(900, "f", "A01", "b5"), row(901, "b", "A01", "b4")]
    parts, so_far, src, out = [rows[:4], rows[4:7], rows[7:10], rows[10:11], rows[11:]], [], str(tmp_path / "src"), str(tmp_path / "map")
    for part in parts:  # one run each: state comes back from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        so_far += part
        beds.keep_bed_map(own.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp"), available_now=True).awaitTermination()
        want = {(r.bed, r.visit) for r in feeds.occupied_beds(spark.createDataFrame(so_far, schema)).collect()}
        assert {(r.bed, r.visit) for r in beds.current_beds(spark, out).collect()} == want
    assert beds.fold("a", True, [("release", "b"), ("claim", "c"), ("release", "c")]) == ("c", False)


def test_further_format_and_arrow_step(spark):
    """A sixth format is registered, read and written by a channel; an Arrow step fails on its own rows alone."""
    from segmenta.plans import formats

    class Pairs:
        """Lines of key=value."""
        def __init__(self, col, name=None):
            self.name, self.col = name, col
            self.error, self.map = col["error"], col["pairs"]

        def get(self, path):
            return F.try_element_at(self.map, F.lit(path))

        def set(self, path, value):
            changed = F.map_concat(F.map_filter(self.map, lambda k, _: k != path), F.create_map(F.lit(path), F.lit(value)))
            return Pairs(F.struct(self.error.alias("error"), changed.alias("pairs")))

        def serialize(self):
            return F.array_join(F.transform(F.array_sort(F.map_entries(self.map)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")

    def parse(df, raw, out):
        text = F.col(raw).cast("string")
        error = F.when(~text.contains("="), F.lit("pairs: no pair"))
        return df.withColumn(out, F.struct(error.alias("error"), F.str_to_map(text, F.lit("\n"), F.lit("=")).alias("pairs")))

    formats.register(formats.Codec("pairs", parse, lambda col: Pairs(F.col(col), col)))
    try:
        with pytest.raises(ValueError):
            formats.register(formats.Codec("pairs", parse, Pairs))
        assert formats.names() == ["astm", "csv", "hl7v2", "json", "pairs", "xml"]
        rows = spark.createDataFrame([(1, "a=1\nb=2"), (2, "nothing"), (3, "b=x"), (4, "b=8")], "msg_id long, raw string").withColumn("meta", F.create_map().cast("map<string,string>"))
        ch = Channel("c", "mllp-listener", "pairs", [Destination("d", "file-writer", "pairs")], transformers=[lambda m: m.set("c", "new")])
        got = {r.msg_id: r for r in run_channel(ch, rows)[0].collect()}
        assert {i: r.transformed and bytes(r.transformed).decode() for i, r in got.items()} == {1: "a=1\nb=2\nc=new", 2: None, 3: "b=x\nc=new", 4: "b=8\nc=new"}
        assert got[2].error_text == "parse (pairs): pairs: no pair"

        def half(batch):
            return [f"b={int(b) // 2}" for b in batch["b"].to_pylist()]

        ch = Channel("c", "mllp-listener", "pairs", [Destination("d", "file-writer", "pairs")],
                     transformers=[lambda m: formats.ArrowText(half, "pairs", b=m.get("b")), lambda m: m.set("z", "after")])
        got = {r.msg_id: (r.state, r.error_text, r.transformed and bytes(r.transformed).decode()) for r in run_channel(ch, rows)[0].collect()}
        assert got[1] == ("TRANSFORMED", "", "b=1\nz=after") and got[4] == ("TRANSFORMED", "", "b=4\nz=after") and got[2][0] == got[3][0] == "ERROR"
        assert got[3][1].startswith("translator 1: ValueError: invalid literal") and got[3][2] is None
        short = Channel("c", "mllp-listener", "pairs", [Destination("d", "file-writer", "pairs")], transformers=[lambda m: formats.ArrowText(lambda b: [], "pairs", b=m.get("b"))])
        assert {r.error_text for r in run_channel(short, rows.filter("msg_id = 1"))[0].collect()} == {"translator 1: ValueError: 0 texts for 1 messages"}
    finally:
        formats.unregister("pairs")
    # a write that a received message does not allow stops that message
    ch = Channel("j", "http-listener", "json", [Destination("d", "file-writer", "json")], transformers=[lambda m: m.set("a[0]", 1)])
    rows = spark.createDataFrame([(1, '{"a":{"b":1}}'), (2, '{"a":[2,3]}')], "msg_id long, raw string").withColumn("meta", F.create_map().cast("map<string,string>"))
    got = {r.msg_id: (r.state, r.error_text) for r in run_channel(ch, rows)[0].collect()}
    assert got == {1: ("ERROR", 'translator 1: json: path "a[0]": [0] applied to an object with keys'), 2: ("TRANSFORMED", "")}


def test_small_rules(spark, tmp_path):
    """Outcomes, error texts, single rows and routes, unique channels, states of messages, payload files, several sinks."""
    df = spark.createDataFrame([("AA", True), ("CA", False), ("", None), ("AE", True), (None, False)], "code string, ok boolean")
    assert [r[0] for r in df.select(outcome.ack_accepted(F.col("code"))).collect()] == [True, True, True, False, True]
    assert [r[0] for r in df.select(outcome.e1381_outcome(F.col("ok"))).collect()] == ["sent", "transient", "transient", "sent", "transient"]
    body = spark.createDataFrame([("  oops \n",), ("",), (" \n",), ("x" * 600,), ("é" * 300,)], "b string")
    assert [r[0] for r in body.select(sc.snippet(F.col("b"))).collect()][:4] == [": oops", "", "", ": " + "x" * 512]
    raw = "MSH|^~\\&|A||||||ADT^A31|1\rPID|1||M1||DOE^JO||19800102\r"
    msgs = parse_delimited(spark.createDataFrame([(raw,), (raw.replace("A31", "A08"),)], "raw string"), HL7V2)
    m = Parsed("msg", HL7V2)
    assert [r[0] for r in msgs.select(tr.patient_csv_row(m).text()).collect()] == ["M1,DOE,JO,19800102\n"] * 2
    route = tr.fhir_patient_routing(m)
    assert [tuple(r) for r in msgs.select(route["http.method"], route["http.path"]).collect()] == [("PUT", "/fhir/Patient/M1"), (None, None)]
    from segmenta.functions.trees import Tree, parse_tree
    from segmenta.plans.channel import check_unique
    x = parse_tree(spark.createDataFrame([("<Patient><id value='1'/></Patient>",), ("<Device><id/></Device>",)], "raw string"), "xml")
    assert [r[0] for r in x.select(tr.fhir_xml_rejection(Tree("msg", "xml"))[0]).collect()] == [False, True]
    a, b = (Channel(i, "mllp-listener", "hl7v2", [Destination("d", "file-writer", "hl7v2")]) for i in "ab")
    assert [c.id for c in check_unique([b, a])] == ["a", "b"]
    with pytest.raises(ValueError):
        check_unique([a, b, a])
    log = spark.createDataFrame([(1, None, 1, "RECEIVED", None, T0), (1, None, 3, "ERROR", "bad", T0), (1, "d", 4, "SENT", None, T0), (2, None, 2, "RECEIVED", None, T0)],
                                "msg_id long, destination_id string, event_seq long, state string, error string, ts timestamp")
    assert sorted((r.msg_id, r.state, r.error_text) for r in store.latest_message_state(log).collect()) == [(1, "ERROR", "bad"), (2, "RECEIVED", "")]
    out = spark.createDataFrame([(i, "c", "d", f"p{i}") for i in range(4)], "msg_id long, channel_id string, destination_id string, payload string")
    files.write_payloads(out, str(tmp_path / "p"), F.when(F.col("msg_id") < 3, "same").otherwise("own"))
    got = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r.unique_name, r.payload, r.channel_id) for r in got.collect()) == [("own", "p3", "c"), ("same", "p0", "c"), ("same.1", "p1", "c"), ("same.2", "p2", "c")]
    rows = spark.createDataFrame([("v1", 1, "A01", "b1"), ("v1", 2, "A02", "b2"), ("v2", 3, "A01", "b1")], "visit string, seq long, trigger string, location string")
    assert sorted(map(tuple, stateful.live_locations(rows).collect())) == [("v1", "A02", "b2"), ("v2", "A01", "b1")]
    rows.write.parquet(str(tmp_path / "s"))
    met = []

    def bad(batch, number):
        raise RuntimeError("down")

    q = intake.multi_sink(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")), {"bad": bad, "good": lambda b, n: met.append(b.count())}, str(tmp_path / "cpm"), True)
    with pytest.raises(Exception, match="bad: down"):
        q.awaitTermination()
    assert met == [3]


def _final_plan(df):
    """The plan as it ran, without the plan it began with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_assembly_reads_its_frames_once(spark):
    f = captures.frame_e1381(spark.range(60).select(F.col("id").alias("conn"), F.concat(F.lit("H|\\^&\rO|1|"), F.col("id").cast("string"), F.lit("\r")).alias("raw")), ["conn"])
    f = captures.deframe_e1381(f.select("conn", "idx", "frame")).select(
        F.col("conn").cast("string").alias("conn"), (F.col("conn") * 100 + F.col("idx")).alias("arrival"), F.lit(None).cast("string").alias("signal"), "number", "text", "last", "error")
    opened = spark.range(1000, 1060).select((F.col("id") - 1000).alias("k")).select(F.col("k").cast("string").alias("conn"), (F.col("k") * 100).alias("arrival"), F.lit(captures.ENQ).alias("signal"), *(
        F.lit(None).cast(t).alias(n) for n, t in (("number", "string"), ("text", "string"), ("last", "boolean"), ("error", "string"))))
    out = captures.assemble_e1381(f.unionByName(opened))
    assert _final_plan(out).count("Range (") == 2  # frames and openings
    assert {bytes(r.raw).decode() for r in out.collect()} == {f"H|\\^&\rO|1|{k}\r" for k in range(60)}


def test_notes_of_repeated_rows_are_kept(spark):
    rows = [("c", 0, captures.ENQ, None, None, None, None)] + [("c", 5, None, "4", "x", False, None)] * 3 + [("c", 9, None, None, None, None, "checksum")]
    s = spark.createDataFrame(rows, "conn string, arrival long, signal string, number string, text string, last boolean, error string")
    assert sorted(r.note for r in captures.assemble_e1381(s).collect()) == ["nak: checksum"] + ["nak: wrong frame number"] * 3


def test_payloads_are_cut_once(spark):
    f = captures.frame_e1381(spark.range(3).select("id", F.concat(F.lit("H|"), F.col("id").cast("string"), F.lit("\r")).alias("raw")), ["id"])
    filters = [x for x in f._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("split(" in x for x in filters)


def test_checksum_of_bytes(spark):
    draw = random.Random(3)
    rows = [(k, None if k % 11 == 0 else "".join(chr(draw.randrange(256)) for _ in range(draw.choice([0, 1, 240])))) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    want = {k: None if t is None else f"{(sum(t.encode('latin-1')) + ord('1') + 3) % 256:02X}" for k, t in rows}
    assert {r.k: r.c for r in df.select("k", sc.checksum(F.lit("1"), F.col("t"), F.lit("\x03")).alias("c")).collect()} == want


def test_odd_leaves_of_every_rule(spark):
    """Leaves with and without anything to encode, of several rules, in fixed and in repeated segments."""
    from segmenta.functions.builder import new_message
    vals = ["plain", "a^b~c&d|e\\f", "x\ty", "", None, "\\X41\\ & \\Q\\"]
    df = spark.createDataFrame([(i, v, w) for i, v in enumerate(vals) for w in vals], "i int, v string, w string")
    v, w = F.col("v"), F.col("w")
    fixed = new_message("hl7v2").set("OBX-1", v).set("OBX-2.1", w).set("OBX-3.1.1", v).set("OBX-4", "k").text()
    again = new_message("hl7v2").repeat("OBX", F.array(F.struct("v", "w")), lambda s, x, i: s.set("1", x["v"]).set("2.1", x["w"]).set("3.1.1", x["v"]).set("4", "k")).text()
    codes = {"|": "\\F\\", "^": "\\S\\", "&": "\\T\\", "~": "\\R\\", "\\": "\\E\\", "\t": "\\X09\\"}
    plain = lambda t, keep: "".join(c if c in keep else codes.get(c, c) for c in t or "")
    for r in df.select("v", "w", fixed.alias("f"), again.alias("g")).collect():
        assert r.f == r.g
        if "Q" not in (r.v or "") + (r.w or ""):  # sequences that no reader knows stay as they are
            assert r.f == f"OBX|{plain(r.v, '^&')}|{plain(r.w, '&')}|{plain(r.v, '')}|k\r"
    quoted = df.select("v", new_message("json").set("a", v).set("b[1]", w).text().alias("j"), "w").collect()
    import json
    assert all(json.loads(r.j) == {"a": r.v or "", "b": [None, r.w or ""]} for r in quoted)


def test_rows_are_dealt_to_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    from segmenta.workload import feeds
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    monkeypatch.setattr(feeds, "ROWS_A_TASK", 90)
    df = feeds.table(spark, str(tmp_path), "t")
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert len(sizes) == 12 and max(sizes) <= 90
    assert sorted(r.id for r in df.collect()) == list(range(1000))


def test_identifiers_and_segments_are_read_once(spark):
    """The filter that an explode implies must not hold the search through the message."""
    from segmenta.operators.leaves import segment_rows
    raw = "MSH|^~\\&|A\rPID|1||7^^^F^MR~9^^^E^PI\rOBX|1\rOBX|2\r"
    df, m = parse_delimited(spark.createDataFrame([(1, raw)], "msg_id int, raw string").repartition(2), HL7V2), Parsed("msg", HL7V2)
    rows = segment_rows(df, ["msg_id"], HL7V2, name="OBX")
    ids = F.transform(F.arrays_zip(m.get_all("PID-3.1").alias("id"), m.get_all("PID-3.4").alias("authority"), m.get_all("PID-3.5").alias("type")),
                      lambda x: F.struct(x["id"].alias("id"), x["authority"].alias("authority"), x["type"].alias("type")))
    pairs = feeds.identity_crosswalk(df, ids)
    for out in (rows, pairs):
        assert not any("lambdafunction" in x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
    assert [(r.pos, r.fields) for r in rows.orderBy("pos").collect()] == [(0, ["OBX", "1"]), (1, ["OBX", "2"])]
    assert [tuple(r) for r in pairs.collect()] == [("F", "7", "9")]


def test_chains_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        read.add(1)
        return k

    df = spark.range(40).select(seen.asNondeterministic()("id").alias("id")).select("id", F.when(F.col("id") >= 10, F.col("id") - 10).alias("to"))
    assert {(r.id, r.survivor) for r in chains.follow(df, "id", "to").collect()} == {(k, k % 10) for k in range(40)}
    assert read.value == 40


def test_rendered_admissions_compile_to_short_methods(spark):
    """A method of more than 8,000 bytes is never compiled to machine code."""
    from segmenta.workload import feeds as work
    kinds = F.array(*(F.lit(k) for k in work.EVENT_TRIGGERS))
    events = spark.range(10).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"),
                                    F.col("id").alias("user_id"), F.get(kinds, (F.col("id") % 6).cast("int")).alias("event_type"))
    df = work.adt_of(events)
    code = df._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.length())) < 8000
    raw = {r.msg_id: r.raw for r in df.collect()}
    assert raw[5] is None and raw[2] == (
        "MSH|^~\\&|SIM|SIMNET|RCV|TEST|19700101003320||ADT^A03^ADT_A03|E2|T|2.5.1\rEVN|A03|19700101003320||||19700101003320\r"
        "PID|1||MAIN0000002^^^MAIN^MR~EID0000002^^^SIMNET^PI||FAM2^G^||19800101|F\r"
        "PV1|1|I|U0^R2^1^MAIN||||||||||||||||V000000002|||||||||||||||||||||||||19700101003320|19700101003320\r")


def test_orders_move_once_and_meet_their_lines_as_text(spark, tmp_path):
    """Both sides are dealt by order alone; a line's values are rendered outside the functions over arrays, which are interpreted."""
    from segmenta.workload import feeds as work
    orders = [(1, 7, "O", "1-URGENT"), (2, 8, "P", None), (None, 7, "F", "2-HIGH"), (3, 9, "F", "5-LOW")]
    lines = [(1, 11, 2.0, 3.5, "2024-01-03 00:00:00"), (2, None, 1.0, None, None), (2, 12, None, 4.0, "2024-01-04 00:00:00")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string") \
        .selectExpr("*", "timestamp'2024-01-02 03:04:05' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "C7"), (8, "C8")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate string").coalesce(1) \
        .selectExpr("* EXCEPT (l_shipdate)", "cast(l_shipdate AS timestamp) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = work.orders_hl7(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert ".l_shipdate" not in plan  # a value of a function's argument
    assert "RoundRobin" not in df._jdf.queryExecution().executedPlan().toString()
    head = lambda key, who, name: f"MSH|^~\\&|SIM||||20240102030405||ORM^O01|ORM{key}|P|2.5.1\rPID|1||{who}||{name}\r"
    assert {r.msg_id: r.raw for r in df.collect()} == {
        None: None, 3: head(3, 9, "") + "ORC|SC|3\r",
        1: head(1, 7, "C7") + "ORC|NW|1\rOBR|1|1||11^^L|1-URGENT||20240103000000||2.00||||||||||||||3.50\r",
        # missing values take their places with them
        2: head(2, 8, "C8") + "ORC|CA|2\rOBR|1|2||^^L|||1.00|||||||||||||\rORC|CA|2\rOBR|1|2||12^^L||20240104000000|||||||||||||||4.00\r"}


def test_segment_rows_do_not_hold_the_message(spark):
    """A row a segment with all segments in each grows with the square of the message; what reads pieces stays."""
    from segmenta.operators.leaves import segment_rows
    df = parse_delimited(spark.createDataFrame([("MSH|^~\\&|A\rOBX|1|a\\S\\b\rOBX|2|c\r",)], "raw string"), HL7V2)
    rows, m = segment_rows(df, ["msg"], HL7V2, name="OBX"), Parsed("msg", HL7V2)
    got = rows.select("pos", m.at(F.col("fields"), "OBX", "2").alias("v"), "msg.segs", "msg.error").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(0, "a^b", None, None), (1, "c", None, None)]


def test_repeated_segments_decode_and_encode_as_a_whole(spark):
    """Pieces with escapes, missing pieces and pieces that need encoding, as one column or in one text."""
    from segmenta.plans import translators as tr
    head = "MSH|^~\\&|LIS||||20240101\rPID|1||7\r"
    raws = [head + "ORC|NW\rOBR|1|s1||t1^x|S||20240102\rORC|CA\rOBR|1|s\\F\\2||t\\S\\2\r", head + "ORC|NW\rOBR|1|a|\rOBR|1|b&c||d\rORC|C\\X41\\\r",
            head + "ORC|NW\r", head]
    df = parse_delimited(spark.createDataFrame(list(enumerate(raws)), "msg_id int, raw string"), HL7V2)
    built = tr.order_to_astm(Parsed("msg", HL7V2))
    got = [(r.one, r.two) for r in built.add_to(df.select("msg_id", "msg"), "two").withColumn("one", built.text()).orderBy("msg_id").collect()]
    assert all(a == b for a, b in got)
    assert [[s for s in a.split("\r") if s[:1] == "O"] for a, _ in got] == [
        ["O|1|s1||^^^t1|S|20240102|||||N", "O|2|s&F&2||^^^t&S&2|R||||||C"], ["O|1|a||^^^|R||||||N", "O|2|b&E&c||^^^d|R||||||C"], [], []]
    with pytest.raises(ValueError):
        Parsed("msg", HL7V2).at_each(F.col("x"), lambda x: [(x, "MSH", "1")])


def test_manifest_counts_bytes_of_the_whole_corpus(spark, tmp_path):
    # parts of three values of the order, one of them without rows, another that ends with a text of several bytes a letter
    texts = {0: "MSH|a\r", 1: "MSH|bb\r", 2: "MSH|é€\r", 3: "MSH|d\r", 9: "MSH|eeeee\r", 10: "MSH|f\r"}
    df = spark.createDataFrame(list(texts.items()), "msg_id long, raw string").repartition(3)
    got = files.corpus_manifest(df, "msg_id", 3).orderBy("msg_id").collect()
    whole, of_part, want = 0, {}, []
    for seq, (i, t) in enumerate(texts.items(), 1):
        n = len(t.encode())
        want.append((seq, i // 3, whole, of_part.get(i // 3, 0), n))
        whole, of_part[i // 3] = whole + n, of_part.get(i // 3, 0) + n
    assert [(r.seq, r.part, r.start, r.offset, r.length) for r in got] == want
    # the query: positions go on beyond its parts of 200
    rows = [(k, f"Customer#{k}", k % 25, ("BUILDING", "AUTOMOBILE")[k % 2]) for k in range(190, 411)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = QUERIES["corpus_offsets"](spark, str(tmp_path)).orderBy("msg_id").collect()
    starts = [0]
    for k, name, _, segment in rows:
        starts.append(starts[-1] + 56 + 2 * len(str(k)) + len(name) + len(segment))
    assert [(r.msg_id, r.start, r.start + r.length) for r in got] == [(r[0], a, b) for r, a, b in zip(rows, starts, starts[1:])]
