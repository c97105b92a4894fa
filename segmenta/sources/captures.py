"""Wire captures held in tables: framed streams and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import materialise
from ..functions.scalars import checksum, frame_number

# Control characters of the two framings.
VT, FS, CR, LF = "\x0b", "\x1c", "\r", "\n"
STX, ETX, EOT, ENQ, ETB = "\x02", "\x03", "\x04", "\x05", "\x17"
MAX_MESSAGE = 10 << 20
FRAME_SIZE = 240
_latin = lambda c: F.decode(c.cast("binary"), "ISO-8859-1")
_bytes = lambda c: F.encode(c, "ISO-8859-1")


def deframe_mllp(captures: DataFrame, key: list[str], col: str = "capture", max_size: int = MAX_MESSAGE) -> DataFrame:
    """key, pos, raw, error: the frames of each capture.

    A stray byte between frames, a frame over the limit or a frame end without
    CR closes the connection, so nothing after the first violation counts; the
    violation itself is one error row."""
    text = F.col("__t")
    df = captures.select(*key, _latin(F.col(col)).alias("__t"))
    # every frame end starts a new piece; the piece after it must open with CR
    pieces = F.split(text, FS)
    n = F.size(pieces)

    def classify(p, i):
        body = F.when(i == 0, p).otherwise(F.substring(p, 2, 1 << 30))
        cr_ok = (i == 0) | F.startswith(p, F.lit(CR))
        cut_cr = (i > 0) & (p == "") & (i == n - 1)
        last = i == n - 1
        starts = F.startswith(body, F.lit(VT))
        size = F.length(body) - 1
        error = (F.when(cut_cr, "unexpected EOF")
                 .when(~cr_ok, F.concat(F.lit("mllp: expected CR after frame end, got 0x"),
                                        F.hex(_bytes(F.substring(p, 1, 1)))))
                 .when(last & (body == ""), "")
                 .when(~starts, F.concat(F.lit("mllp: expected frame start 0x0B, got 0x"),
                                         F.when(body == "", F.lit("1C")).otherwise(F.hex(_bytes(F.substring(body, 1, 1))))))
                 .when(size > max_size, f"mllp: message exceeds maximum size {max_size}")
                 .when(last, "unexpected EOF"))
        return F.struct(i.alias("pos"), F.substring(body, 2, 1 << 30).alias("body"), error.alias("error"))

    # A frame counts once its CR was seen, which is the next piece's business.
    got = df.select(*key, F.transform(pieces, classify).alias("p"))
    bad = F.coalesce(F.array_position(F.transform("p", lambda x: x["error"].isNotNull()), F.lit(True)), F.lit(0))
    got = got.withColumn("__bad", bad.cast("int"))
    cut_by_cr = F.coalesce(F.get(F.col("p"), F.col("__bad") - 1)["error"].rlike("after frame end|unexpected EOF")
                           & (F.get(F.col("p"), F.col("__bad") - 1)["body"] == ""), F.lit(False))
    cr_fault = F.coalesce(F.get(F.col("p"), F.col("__bad") - 1)["error"].rlike("after frame end"), F.lit(False)) | cut_by_cr
    keep = F.when(F.col("__bad") == 0, F.size("p")).otherwise(F.col("__bad") - 1 - F.when(cr_fault, 1).otherwise(0))
    frames = F.transform(F.slice("p", F.lit(1), F.greatest(keep, F.lit(0))), lambda x: F.struct(
        x["pos"].alias("pos"), _bytes(x["body"]).alias("raw"), F.lit(None).cast("string").alias("error")))
    fault = F.get(F.col("p"), F.col("__bad") - 1)
    tail = F.when((F.col("__bad") > 0) & (fault["error"] != ""), F.array(F.struct(
        fault["pos"].alias("pos"), F.lit(None).cast("binary").alias("raw"), fault["error"].alias("error")))).otherwise(
        F.array().cast("array<struct<pos:int,raw:binary,error:string>>"))
    return got.select(*key, F.explode(F.concat(frames, tail)).alias("x")).select(*key, "x.pos", "x.raw", "x.error")


def frame_mllp(payload: Column) -> Column:
    return F.concat(F.unhex(F.lit("0B")), payload.cast("binary"), F.unhex(F.lit("1C0D")))


def deframe_e1381(frames: DataFrame, col: str = "frame", max_text: int = FRAME_SIZE) -> DataFrame:
    """Add number, text, last, error for each captured transfer frame."""
    t, before, term, tail, want = (F.col(f"__{n}") for n in ("t", "before", "term", "tail", "want"))
    number = F.substring(t, 2, 1)
    body = F.substring(t, 3, 1 << 30)
    # one stage per level, so that no piece is computed once per use
    df = frames.withColumn("__t", _latin(F.col(col)))
    df = df.withColumn("__before", F.regexp_extract(body, "^([^\x03\x17]*)", 1))
    df = df.withColumns({"__term": F.call_function("substring", body, F.length(before) + 1, F.lit(1)),
                         "__tail": F.call_function("substring", body, F.length(before) + 2, F.lit(4))})
    df = df.withColumn("__want", checksum(number, F.substring(before, 1, max_text), term))
    error = (F.when(t == "", "unexpected EOF")
             .when(~t.startswith(STX), F.concat(F.lit("astm1381: expected STX, got 0x"), F.hex(_bytes(F.substring(t, 1, 1)))))
             .when(F.length(t) < 2, "unexpected EOF")
             .when(~number.rlike("^[0-7]$"), F.concat(F.lit("astm1381: invalid frame number 0x"), F.hex(_bytes(number))))
             .when(F.length(before) > max_text, f"astm1381: frame text exceeds {max_text} bytes")
             .when((term == "") | (F.length(tail) < 4), "unexpected EOF")
             .when(F.substring(tail, 1, 2) != want, F.concat(
                 F.lit("astm1381: checksum mismatch (got "), F.substring(tail, 1, 2), F.lit(", want "), want, F.lit(")")))
             .when(F.substring(tail, 3, 2) != CR + LF, "astm1381: frame not terminated by CR LF"))
    df = df.withColumn("error", error)
    ok = F.col("error").isNull()
    return df.withColumns({"number": F.when(ok, number), "text": F.when(ok, before), "last": F.when(ok, term == ETX)}).drop(
        "__t", "__before", "__term", "__tail", "__want")


def frame_e1381(df: DataFrame, key: list[str], col: str = "raw", frame_size: int = FRAME_SIZE) -> DataFrame:
    """key, idx (1-based), number, text, last, frame: payloads cut into
    transfer frames, one record per frame, long records continued.

    The cut is array work inside the row, so no window is needed to find the
    last frame."""
    text = _latin(F.col(col))
    records = F.split(text, f"(?<={CR})")
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.length(r) - 1) / frame_size).cast("int")),
                                lambda k: F.call_function("substring", r, k * frame_size + 1, F.lit(frame_size)))
    texts = F.flatten(F.transform(F.filter(records, lambda r: r != ""), cut))
    # materialised, else the filter that an explode implies would cut every payload again, at the scan
    got = materialise(df, "__x", F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(""))), key)
    got = got.select(*key, F.size("__x").alias("__n"), F.posexplode("__x").alias("__i", "text"))
    last = F.col("__i") == F.col("__n") - 1
    number = frame_number(F.col("__i") + 1)
    term = F.when(last, ETX).otherwise(ETB)
    frame = F.concat(F.lit(STX), number, F.col("text"), term, checksum(number, F.col("text"), term), F.lit(CR + LF))
    return got.select(*key, (F.col("__i") + 1).alias("idx"), number.alias("number"), "text", last.alias("last"),
                      _bytes(frame).alias("frame"))


def assemble_e1381(frames: DataFrame, max_message: int = MAX_MESSAGE) -> DataFrame:
    """conn, session, raw, first_arrival, frames, note: the messages of each captured connection, and a note per refused frame.

    ``frames``: conn, arrival, signal (ENQ, EOT or NULL), number, text, last, error.  A session reaches from an ENQ to
    the next ENQ or EOT.  A frame outside a session, or bytes that are no frame, end their connection: only what came
    before counts.  Frames with a wrong checksum are refused, and so is one whose number does not follow the frame before
    it while the frame after it does.  Of the others one is taken if its number is the next, and is a duplicate if it is
    the same; a gap refuses the rest of the session.  A message is the text of the frames taken up to a last one, in
    order; an unfinished one is dropped, a too large one noted.

    All of it is running values and aggregates: a connection or session with very many frames is spread over tasks.  Each
    pass keeps what later passes read and nothing else, so that its rows and its totals come from one exchange, and
    messages and notes come from one aggregate: no pass is run twice."""
    from ..operators.chunked import id_chunk, running
    at, signal, quiet = F.col("arrival"), F.col("signal"), F.col("signal").isNull()
    chunk, number, own = id_chunk(at), F.col("__n"), F.col("__own")
    seen = running(frames.select("conn", "arrival", "signal", "number", "text", "last", "error"), ["conn"], ["arrival"], chunk,
                   session=("sum", F.when(signal == ENQ, 1).otherwise(0)), under=("last", signal))
    foreign = F.coalesce(F.col("error").startswith("astm1381: expected STX"), F.lit(False))
    heard = seen.filter(quiet).select(
        "conn", "arrival", F.col("session").cast("int").alias("session"), F.when(F.col("error").isNull(), F.col("number").cast("int")).alias("__n"),
        "text", "last", "error", ((F.coalesce("under", F.lit(EOT)) == EOT) | foreign).alias("__stray"))
    # the first stray of a connection, as seen from the rows behind it, is its end
    ended = running(heard, ["conn"], ["arrival"], chunk, __end=("max", F.when(F.col("__stray"), -at))).withColumn("__end", -F.col("__end"))
    outside = F.coalesce(at == F.col("__end"), F.col("__stray"))
    fault = (F.when(outside & foreign, F.col("error")).when(outside, "frame outside a session")
             .when(F.col("error").isNotNull(), F.concat(F.lit("nak: "), F.col("error"))))
    live = ended.filter(F.col("__end").isNull() | (at <= F.col("__end"))).select(
        "conn", "session", "arrival", "text", "last", fault.alias("__fault"), F.when(~outside, number).alias("__n"))
    beyond = lambda n, before: F.pmod(n - F.coalesce(F.col(before), F.lit(0)), F.lit(8))  # a session's first frame is number 1
    key, rest = ["conn", "session"], ["conn", "session", "arrival", "text", "last", "__fault"]
    near = running(live, key, ["arrival"], chunk, __prev=("last", number), __next=("next", number))
    foreign_number = (beyond(number, "__prev") > 1) & F.coalesce(beyond(F.col("__next"), "__prev") <= 1, F.lit(False))
    steps = running(near.select(*rest, F.when(~foreign_number, number).alias("__own")), key, ["arrival"], chunk, __before=("last", own))
    step, gaps = F.col("__step"), F.col("__gaps")
    judged = steps.select(*rest, beyond(own, "__before").alias("__step"), F.col("__before").isNotNull().alias("__again"))
    # before a gap every next number was taken; behind it nothing is, so its count of messages is of no matter
    placed = running(judged, key, ["arrival"], chunk, __gaps=("sum", F.when(step > 1, 1).otherwise(0)),
                     __message=("sum", F.when((step == 1) & F.col("last"), 1).otherwise(0)))
    taken = F.col("__taken")
    note = F.when(F.col("__fault").isNotNull(), F.col("__fault")).when((step == 0) & (gaps == 0) & F.col("__again"), "duplicate").otherwise("nak: wrong frame number")
    # a message is a group; every other frame is one of its own, with its note
    groups = placed.withColumn("__taken", F.coalesce((step == 1) & (gaps == 0), F.lit(False))).groupBy(
        "conn", "session", taken, F.when(taken, F.col("__message")).alias("__message"), F.when(~taken, at).alias("__at"), F.when(~taken, note).alias("__note")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(taken, F.struct("arrival", "text")))), lambda x: x["text"]), "").alias("text"),
        F.min("arrival").alias("first_arrival"), F.count("*").cast("int").alias("frames"), F.bool_or("last").alias("done"), F.sum(F.length("text")).alias("size"))
    fits = taken & (F.col("size") <= max_message)
    rows = F.array_repeat(F.lit(0), F.when(taken, F.when(F.col("done"), 1).otherwise(0)).otherwise(F.col("frames")))
    return groups.select("*", F.explode(rows).alias("__row")).select(
        "conn", "session", F.when(fits, _bytes(F.col("text"))).alias("raw"), "first_arrival", F.when(fits, F.col("frames")).otherwise(0).alias("frames"),
        F.when(~taken, F.col("__note")).when(~fits, "message too large").alias("note"))


def ingest_http(df: DataFrame, path: str, max_body: int = MAX_MESSAGE, authorized: Column | None = None) -> DataFrame:
    """Request rows (method, url_path, query, content_type, remote, body) with
    ``refused`` (HTTP status or NULL) and the message meta.

    The first value of a repeated query parameter wins."""
    body = F.col("body").cast("binary")
    refused = (F.when(F.col("url_path") != path, 404)
               .when(~(authorized if authorized is not None else F.lit(True)), 401)
               .when(~F.col("method").isin("POST", "PUT"), 405)
               .when(F.length(body) > max_body, 413)
               .when(body.isNull() | (F.length(body) == 0), 400))
    pairs = F.filter(F.split(F.coalesce("query", F.lit("")), "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    part = lambda p, i: F.try_url_decode(F.get(F.split(p, "=", 2), F.lit(i)))
    named = F.filter(F.transform(pairs, lambda p: F.struct(
        part(p, 0).alias("k"), F.coalesce(part(p, 1), F.lit("")).alias("v"))), lambda x: x["k"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda x: x["k"]))
    query = F.map_from_entries(F.transform(names, lambda k: F.struct(
        F.concat(F.lit("source.http.query."), k),
        F.get(F.filter(named, lambda x: x["k"] == k), F.lit(0))["v"])))
    fixed = F.map_filter(F.create_map(
        F.lit("source.remote"), F.col("remote"), F.lit("source.http.method"), F.col("method"),
        F.lit("source.http.path"), F.col("url_path"),
        F.lit("source.http.header.content-type"), F.nullif("content_type", F.lit(""))), lambda k, v: v.isNotNull())
    return df.withColumns({"refused": refused, "meta": F.map_concat(fixed, query), "raw": body})
