"""Channels as DataFrame plans.

A channel is declared in Python or loaded from a plain dict; its filters and
translators are functions from a :class:`Message` to Columns or builders and
run once, while the plan is made.  Executing it takes a table of recorded
messages and returns the pipeline outcome per message and the outcome per
message and destination.  Every row is narrow work: nothing shuffles here.

An error stops one message only: each step is guarded by the errors of the
steps before it, and no expression raises.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import materialise
from ..functions.delimited import Parsed
from ..functions.outcome import ack_decision
from ..functions.scalars import DURATION_UNITS
from ..functions.trees import Tree
from ..operators.store import ERROR, FILTERED, QUEUED, TRANSFORMED
from . import formats

# Adapter kinds a channel may name.
SOURCES = ("astm-listener", "file-reader", "http-listener", "mllp-listener")
ADAPTERS = ("astm-sender", "file-writer", "http-sender", "mllp-sender")


def seconds_of(text) -> float:
    """Seconds of an option such as '30s'; a bare number is refused."""
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        raise ValueError(f"invalid duration {text}: a unit is required (e.g. {text}s)")
    unit = "|".join(sorted(DURATION_UNITS, key=len, reverse=True))
    if not isinstance(text, str) or not re.fullmatch(rf"[+-]?(?:0|(?:(?:\d+\.?\d*|\.\d+)(?:{unit}))+)", text):
        raise ValueError(f'invalid duration "{text}"')
    total = sum(float(n) * DURATION_UNITS[u] for n, u in re.findall(rf"(\d+\.?\d*|\.\d+)({unit})", text))
    if text.startswith("-") and total:
        raise ValueError(f'invalid duration "{text}": must not be negative')
    return total


def parse_messages(df: DataFrame, data_type: str, raw: str = "raw", out: str = "msg") -> DataFrame:
    """Add the parsed column of any registered format."""
    return formats.codec(data_type).parse(df, raw, out)


def reader(data_type: str, col: str = "msg"):
    """Accessors over a parsed column of any registered format."""
    return formats.codec(data_type).view(col)


class Message:
    """What a filter or translator function sees."""

    def __init__(self, view, data_type: str, meta: Column):
        self.view, self.data_type, self._meta = view, data_type, meta
        self.rejections: list[tuple[Column, Column, Column]] = []
        self.ack: tuple[Column, Column] | None = None
        self.meta_changes: dict[str, Column | None] = {}

    def __getattr__(self, name):
        return getattr(self.view, name)

    def set(self, path: str, value) -> "Message":
        self.view = self.view.set(path, value)
        return self

    def each_segment(self, name: str, write, where=None) -> "Message":
        self.view = self.view.each_segment(name, write, where)
        return self

    def meta(self, key: str) -> Column:
        return F.try_element_at(self._meta, F.lit(key))

    def set_meta(self, key: str, value) -> None:
        """A NULL value leaves the key as it is."""
        self.meta_changes[key] = value if isinstance(value, Column) else F.lit(str(value))

    def delete_meta(self, key: str) -> None:
        self.meta_changes[key] = None

    def reject(self, when: Column, code, text) -> None:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        self.rejections.append((F.coalesce(when, F.lit(False)), as_col(code), as_col(text)))

    def set_ack(self, code, text="", when: Column | None = None) -> None:
        code = code if isinstance(code, Column) else F.lit(code)
        self.ack = (code if when is None else F.when(when, code), text if isinstance(text, Column) else F.lit(text))

    def rejection(self) -> Column:
        """STRUCT<code, text> of the first rejection that applies."""
        expr = F.lit(None).cast("struct<code:string,text:string>")
        for cond, code, text in reversed(self.rejections):
            expr = F.when(cond, F.struct(code.cast("string").alias("code"), text.cast("string").alias("text"))).otherwise(expr)
        return expr

    def meta_after(self) -> Column:
        out = self._meta
        for k, v in self.meta_changes.items():
            others = F.map_filter(out, _without(k))
            if v is None:
                out = others
            else:
                text = v.cast("string")
                out = F.when(text.isNull(), out).otherwise(F.map_concat(others, F.create_map(F.lit(k), text)))
        return out


def _without(k: str):
    return lambda key, _: key != F.lit(k)


@dataclass
class Destination:
    id: str
    adapter: str
    data_type: str = ""
    wait_for_ack: bool = False
    filter: Callable | None = None
    transformers: list[Callable] = field(default_factory=list)
    max_attempts: int = 10
    retry_interval: str = "1s"


@dataclass
class Channel:
    id: str
    source: str
    data_type: str
    destinations: list[Destination]
    name: str = ""
    enabled: bool = True
    retention: int = 1000
    max_pending: int = 0
    log_fields: dict[str, str] = field(default_factory=dict)
    filter: Callable | None = None
    transformers: list[Callable] = field(default_factory=list)

    def __post_init__(self):
        self.name = self.name or self.id
        for d in self.destinations:
            d.data_type = d.data_type or self.data_type
        self.validate()

    @classmethod
    def from_dict(cls, spec: dict) -> "Channel":
        """Unknown keys are errors."""
        dest = [_strict(Destination, d) for d in spec.get("destinations", [])]
        return _strict(cls, {**spec, "destinations": dest})

    def validate(self) -> None:
        def need(ok, text):
            if not ok:
                raise ValueError(f"channel {self.id}: {text}" if self.id else f"channel: {text}")
        need(self.id, "id is required")
        need(self.source, "source.type is required")
        need(self.source in SOURCES, f'unknown source type "{self.source}" (registered: {list(SOURCES)})')
        need(self.data_type, "source.dataType is required")
        need(self.data_type in formats.names(), f'unknown source dataType "{self.data_type}" (registered: {formats.names()})')
        need(self.destinations, "at least one destination is required")
        seen = set()
        for i, d in enumerate(self.destinations, 1):
            need(d.id, f"destination {i}: id is required")
            need(d.id not in seen, f'duplicate destination id "{d.id}"')
            seen.add(d.id)
            at = f"destination {d.id}: "
            need(d.data_type in formats.names(), f'{at}unknown dataType "{d.data_type}" (registered: {formats.names()})')
            need(d.adapter, f"{at}adapter.type is required")
            need(d.adapter in ADAPTERS, f'{at}unknown adapter type "{d.adapter}" (registered: {list(ADAPTERS)})')
            need(d.max_attempts > 0 or d.max_attempts == -1, f"{at}queue.maxAttempts must be positive or -1")
            seconds_of(d.retry_interval)
        need(self.retention > 0 or self.retention == -1, "retention must be positive or -1 (unlimited)")
        need(self.max_pending >= 0, "maxPending must be positive")


def _strict(cls, spec: dict):
    known = {f.name for f in dataclasses.fields(cls)}
    extra = sorted(set(spec) - known)
    if extra:
        raise ValueError(f"{cls.__name__.lower()}: unknown keys {extra}")
    return cls(**spec)


def check_unique(channels: list[Channel]) -> list[Channel]:
    seen = set()
    for c in channels:
        if c.id in seen:
            raise ValueError(f'duplicate channel id "{c.id}"')
        seen.add(c.id)
    return sorted(channels, key=lambda c: c.id)


# ---- execution ------------------------------------------------------------

_REJ = "struct<code:string,text:string>"


class _Run:
    """Columns of one chain while it is being planned."""

    def __init__(self, df: DataFrame, data_type: str, prefix: str, msg: str | None = None):
        self.df, self.data_type, self.p = df, data_type, prefix
        self.msg = msg or f"{prefix}msg"
        self.built = None  # text column of a built message that was not read back yet

    def message(self) -> Message:
        if self.built:
            self.msg = f"{self.p}msg"
            self.df = parse_messages(self.df, self.data_type, self.built, self.msg)
            self.built = None
        return Message(reader(self.data_type, self.msg), self.data_type, F.col(f"{self.p}meta"))

    def fail(self, cond: Column, text: Column, rej: Column | None = None) -> None:
        err, r = F.col(f"{self.p}error"), F.col(f"{self.p}rej")
        first = err.isNull() & F.coalesce(cond, F.lit(False))
        self.df = self.df.withColumns({
            f"{self.p}error": F.when(first, text).otherwise(err),
            f"{self.p}rej": r if rej is None else F.when(first, rej).otherwise(r)})

    def step(self, fn: Callable, label: str):
        """Run one function; record its rejections, meta and ack."""
        m = self.message()
        got = fn(m)
        rej = m.rejection()
        if m.rejections:
            self.df = self.df.withColumn("__r", rej)
            self.fail(F.col("__r").isNotNull(), F.concat(
                F.lit(f"{label}: rejected ("), F.col("__r.code"), F.lit("): "), F.col("__r.text")), F.col("__r"))
            self.df = self.df.drop("__r")
        ok = F.col(f"{self.p}error").isNull()
        changes = {}
        if m.meta_changes:
            changes[f"{self.p}meta"] = F.when(ok, m.meta_after()).otherwise(F.col(f"{self.p}meta"))
        if m.ack is not None:
            for name, value in zip(("ack", "acktext"), m.ack):
                changes[f"{self.p}{name}"] = F.coalesce(F.when(ok & m.ack[0].isNotNull(), value), F.col(f"{self.p}{name}"))
        if changes:
            self.df = self.df.withColumns(changes)
        return m, got

    def translate(self, fns: list[Callable]) -> None:
        for i, fn in enumerate(fns, 1):
            m, got = self.step(fn, f"translator {i}")
            if got is None or isinstance(got, (Message, type(m.view))):
                view = got.view if isinstance(got, Message) else got if got is not None else m.view
                if getattr(view, "name", "") is None:
                    self.msg = f"{self.p}msg"
                    self.df = materialise(self.df, self.msg, view.col)
                    if not isinstance(view, Parsed):  # a write that the structure does not allow stops its message
                        refused = F.col(f"{self.msg}.error")
                        self.fail(refused.isNotNull(), F.concat(F.lit(f"translator {i}: "), refused))
                continue
            if isinstance(got, formats.ArrowText):
                made = f"{self.p}made"
                kept = self.df.columns
                self.df = materialise(self.df.withColumn(f"__{made}", got.result()), made, F.col(f"__{made}"), kept)
                self.fail(F.col(f"{made}.error").isNotNull(), F.concat(F.lit(f"translator {i}: "), F.col(f"{made}.error")))
                self.data_type, self.built = got.data_type, f"{self.p}text"
                self.df = self.df.withColumn(self.built, F.when(F.col(f"{self.p}error").isNull(), F.col(f"{made}.text"))).drop(made)
                continue
            # a built message replaces the tree and the data type
            self.data_type = _type_of(got)
            self.built = f"{self.p}text"
            self.df = self.df.withColumn(self.built, F.when(F.col(f"{self.p}error").isNull(), got.text()))

    def payload(self) -> Column:
        if self.built:
            return F.col(self.built).cast("binary")
        view = reader(self.data_type, self.msg)
        text = view.serialize_bytes() if isinstance(view, Parsed) else view.serialize().cast("binary")
        return F.when(F.col(f"{self.p}error").isNull(), text)


def _type_of(builder) -> str:
    spec = getattr(builder, "spec", None)
    return spec.name if spec is not None else type(builder).__name__.removesuffix("Builder").lower()


def run_channel(channel: Channel, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, destinations) after the pipeline.

    ``messages`` needs msg_id, raw and meta; other columns pass through."""
    keep = messages.columns
    df = parse_messages(messages, channel.data_type, "raw", "c_msg")
    df = df.withColumns({
        "c_meta": F.col("meta"), "c_ack": F.lit(None).cast("string"), "c_acktext": F.lit(None).cast("string"),
        "c_rej": F.lit(None).cast(_REJ),
        "c_error": F.when(F.col("c_msg.error").isNotNull(),
                          F.concat(F.lit(f"parse ({channel.data_type}): "), F.col("c_msg.error")))})
    run = _Run(df, channel.data_type, "c_")
    if channel.log_fields:
        run.df = run.df.withColumn("labels", log_fields(run.message().view, channel.log_fields))
    pass_it = F.lit(True)
    if channel.filter is not None:
        _, pass_it = run.step(channel.filter, "filter")
    run.df = run.df.withColumn("c_pass", F.coalesce(pass_it, F.lit(False)))
    run.translate(channel.transformers)
    ok = F.col("c_error").isNull()
    passed = ok & F.col("c_pass")
    state = F.when(~ok, ERROR).when(~F.col("c_pass"), FILTERED).otherwise(TRANSFORMED)
    run.df = run.df.withColumns({
        "state": state, "error_text": F.coalesce("c_error", F.lit("")),
        "transformed": F.when(passed, run.payload()), "transformed_data_type": F.when(passed, run.data_type)})
    auto = ack_decision(F.when(F.col("c_rej").isNotNull(), "reject").when(~ok, "error"), F.col("c_rej.code"))
    override = F.when(F.col("state") == TRANSFORMED, F.nullif("c_ack", F.lit("")))
    said = F.when(F.col("c_rej").isNotNull(), F.col("c_rej.text")).when(~ok, F.col("c_error"))
    run.df = run.df.withColumns({
        "ack_code": F.coalesce(override, auto), "ack_explicit": override.isNotNull(),
        "ack_text": F.coalesce(F.when(override.isNotNull(), F.col("c_acktext")).otherwise(said), F.lit(""))})
    outer = [*keep, *(["labels"] if channel.log_fields else [])]
    outer = [c for c in outer if c not in ("state", "error_text", "transformed", "transformed_data_type", "meta")]
    out = run.df.select(*outer, F.col("c_meta").alias("meta"), "state", "error_text", "transformed",
                        "transformed_data_type", "ack_code", "ack_text", "ack_explicit")
    return out, _fan_out(channel, run)


def _fan_out(channel: Channel, base: _Run) -> DataFrame:
    """Each passed message times each destination.

    All chains are planned over the same rows and the outcomes are exploded,
    so a message is read and parsed once however many destinations it has."""
    base.message()  # read back what the channel's last translator built
    df = base.df.filter(F.col("state") == TRANSFORMED).select("msg_id", base.msg, "c_meta")
    rows = []
    for i, d in enumerate(channel.destinations):
        p = f"d{i}_"
        df = df.withColumns({
            f"{p}meta": F.col("c_meta"), f"{p}ack": F.lit(None).cast("string"), f"{p}acktext": F.lit(None).cast("string"),
            f"{p}rej": F.lit(None).cast(_REJ), f"{p}error": F.lit(None).cast("string")})
        run = _Run(df, base.data_type, p, base.msg)
        keep = F.lit(True)
        if d.filter is not None:
            _, keep = run.step(d.filter, "filter")
        run.df = run.df.withColumn(f"{p}pass", F.coalesce(keep, F.lit(False)))
        run.translate(d.transformers)
        if run.data_type != d.data_type:
            run.fail(F.col(f"{p}pass"), F.lit(f"serialize ({d.data_type}): message is {run.data_type}"))
        ok = F.col(f"{p}error").isNull()
        sent = ok & F.col(f"{p}pass")
        df = materialise(run.df, f"{p}out", F.struct(
            F.lit(d.id).alias("destination_id"),
            F.when(~ok, ERROR).when(~F.col(f"{p}pass"), FILTERED).otherwise(QUEUED).alias("state"),
            F.when(sent, run.payload()).alias("payload"), F.lit(d.data_type).alias("data_type"),
            F.when(sent, stamp_delivery(F.col(f"{p}meta"), channel.id, d.id)).alias("meta"),
            F.coalesce(f"{p}error", F.lit("")).alias("last_error"), F.lit(0).alias("attempts"),
            F.coalesce(~ok, F.lit(False)).alias("dead_letter"), F.col(f"{p}rej.code").alias("reject_code"),
            F.col(f"{p}rej.text").alias("reject_text"), F.col(f"{p}ack").alias("ack_override"), F.col(f"{p}acktext").alias("ack_override_text")), ["msg_id", base.msg, "c_meta", *rows])
        rows.append(f"{p}out")
    return df.select("msg_id", F.explode(F.array(*rows)).alias("x")).select("msg_id", "x.*")


def stamp_delivery(meta: Column, channel_id: str, destination_id: str) -> Column:
    """Meta of a delivery: what is sent, from where, to where."""
    stamp = F.create_map(F.lit("message.id"), F.col("msg_id").cast("string"), F.lit("channel.id"), F.lit(channel_id),
                         F.lit("destination.id"), F.lit(destination_id))
    own = F.map_filter(meta, lambda k, _: ~k.isin("message.id", "channel.id", "destination.id"))
    return F.map_concat(own, stamp)


def log_fields(view, fields: dict[str, str]) -> Column:
    """Labels of a message sorted by label; unmatched and empty are left out."""
    names = sorted(fields)
    full = F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(view.get(fields[n]) for n in names)))
    return F.map_filter(full, lambda _, v: F.coalesce(v != "", F.lit(False)))


def source_ack(messages: DataFrame, outcomes: DataFrame, wait_order: list[str], order: list[str] | None = None) -> DataFrame:
    """Acknowledgement (``ack_code``, ``ack_text``) per message once its ``wait_order`` destinations are done.

    ``outcomes``: msg_id, destination_id, kind (NULL sent, 'reject', 'permanent', 'error'), reject_code, reject_text,
    error, override, override_text.  The first failing destination in order decides; an explicit answer wins, the
    channel's own unless a destination gives one, of several the last in ``order`` (all destinations of the channel)."""
    place = lambda names: F.array_position(F.array(*(F.lit(w) for w in names)), F.col("destination_id"))
    rank, waited = place(order or wait_order), place(wait_order)
    bad = F.struct(waited.alias("rank"), "kind", "reject_code", "reject_text", "error", "destination_id")
    per = outcomes.groupBy("msg_id").agg(
        F.min(F.when(F.col("kind").isNotNull() & (waited > 0), bad)).alias("b"),
        F.max(F.when(F.coalesce("override", F.lit("")) != "", F.struct(rank.alias("rank"), "override", "override_text"))).alias("o"))
    auto = ack_decision(F.col("b.kind"), F.col("b.reject_code"))
    said = F.when(F.col("b.kind") == "reject", F.col("b.reject_text")).when(
        F.col("b.kind").isNotNull(), F.concat(F.lit("destination "), F.col("b.destination_id"), F.lit(": "), F.col("b.error")))
    took_over, decides = F.col("o.override").isNotNull(), (F.col("ack_code") == "AA") & F.col("b.kind").isNotNull() & ~F.col("ack_explicit")
    done = F.col("state") == TRANSFORMED
    pick = lambda explicit, automatic, own: F.when(done & took_over, explicit).when(done & decides, automatic).otherwise(own)
    return messages.join(per, "msg_id", "left").withColumns({
        "ack_text": F.coalesce(pick(F.col("o.override_text"), said, F.col("ack_text")), F.lit("")),
        "ack_code": pick(F.col("o.override"), auto, F.col("ack_code"))}).drop("b", "o")
