"""Analyses of admission, order and result feeds.

Input of the visit operators: one row per event with visit, seq (unique and
increasing), ts, trigger and, where named, location columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import materialise
from .chunked import id_chunk, running, time_chunk

# Trigger events by what they do to a visit.
ADMIT, TRANSFER, DISCHARGE, UPDATE, CANCEL = "A01", "A02", "A03", "A08", "A11"
CLOSING = (DISCHARGE, CANCEL)


def lifecycle_breaches(events: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """One row per breach: visit, seq, trigger, breach."""
    t = F.col("trigger")
    flag = lambda c: F.when(c, 1).otherwise(0)
    # only what is read here, so that rows and totals need the same exchange
    e = running(events.select("visit", "seq", "ts", "trigger"), ["visit"], ["seq"], id_chunk(F.col("seq"), chunk_rows),
                admits=("sum", flag(t == ADMIT)), closes=("sum", flag(t.isin(*CLOSING))),
                prev=("last", F.struct("ts")))
    admitted, closed = F.col("admits") > 0, F.col("closes") > 0
    needs_admit = t.isin(TRANSFER, UPDATE, *CLOSING)
    found = F.array_compact(F.array(
        F.when((t == ADMIT) & admitted, "admitted twice"),
        F.when(needs_admit & ~admitted, "before admission"),
        F.when(t.isin(TRANSFER, UPDATE) & closed, "after close"),
        F.when(t.isin(*CLOSING) & closed, "closed twice"),
        F.when(F.col("ts") < F.col("prev.ts"), "backwards in time")))
    return e.select("visit", "seq", "trigger", F.explode(found).alias("breach"))


def bed_events(events: DataFrame) -> DataFrame:
    """Claims and releases per bed; a transfer releases before it claims."""
    t = F.col("trigger")
    row = lambda step, kind, bed: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), bed.alias("bed"))
    acts = F.array_compact(F.array(
        F.when((t == TRANSFER) & (F.coalesce("prior", F.lit("")) != ""), row(0, "release", F.col("prior"))),
        F.when(t.isin(*CLOSING), row(0, "release", F.col("location"))),
        F.when(t.isin(ADMIT, TRANSFER), row(1, "claim", F.col("location")))))
    return events.select("visit", "seq", "trigger", "ts", F.explode(acts).alias("a")).select(
        "visit", "seq", "trigger", "ts", "a.step", "a.kind", "a.bed")


def effective_bed_events(events: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Bed events without the releases by visits that do not hold the bed."""
    return _held(bed_events(events), chunk_rows)


def _held(acts: DataFrame, chunk_rows: int) -> DataFrame:
    e = running(acts, ["bed"], ["seq", "step"], id_chunk(F.col("seq"), chunk_rows),
                holder=("last", F.when(F.col("kind") == "claim", F.col("visit"))))
    return e.filter((F.col("kind") == "claim") | F.col("visit").eqNullSafe(F.col("holder"))).drop("holder")


def bed_conflicts(events: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Claims of a bed another visit still holds: visit, seq, bed, held_by."""
    e = running(_held(bed_events(events).drop("ts"), chunk_rows), ["bed"], ["seq", "step"], id_chunk(F.col("seq"), chunk_rows),
                prev=("last", F.struct("kind", "visit")))
    return e.filter((F.col("kind") == "claim") & (F.col("prev.kind") == "claim")
                    & (F.col("prev.visit") != F.col("visit"))).select(
        "visit", "seq", "trigger", "bed", F.col("prev.visit").alias("held_by"))


def occupied_beds(events: DataFrame, chunk_rows: int = 1 << 20) -> DataFrame:
    """Beds held at the end of the feed: bed, visit."""
    last = F.max(F.struct("seq", "step", "kind", "visit"))
    return _held(bed_events(events).drop("ts", "trigger"), chunk_rows).groupBy("bed").agg(last.alias("l")).filter(
        F.col("l.kind") == "claim").select("bed", F.col("l.visit").alias("visit"))


def latest_per(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key as an aggregate; it combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *columns)).alias("l")).select(
        *keys, *(F.col(f"l.{c}").alias(c) for c in columns))


def census(events: DataFrame, unit: Column) -> DataFrame:
    """Open encounters per unit: visits whose last lifecycle event is an
    admission, where their last known location puts them."""
    t = F.col("trigger")
    seq = F.col("seq")
    state = events.groupBy("visit").agg(
        F.max_by(t, F.when(t.isin(ADMIT, *CLOSING), seq)).alias("state"),
        F.max_by("location", F.when(t.isin(ADMIT, TRANSFER), seq)).alias("location"))
    return state.filter(F.col("state") == ADMIT).groupBy(unit.alias("unit")).agg(F.count("*").alias("census"))


def occupancy(census_rows: DataFrame, beds: DataFrame) -> DataFrame:
    """Share of beds in use per unit; units without patients count 0."""
    return beds.join(census_rows, "unit", "left").select(
        "unit", "beds", F.coalesce("census", F.lit(0)).alias("census"),
        (F.coalesce("census", F.lit(0)) / F.col("beds")).alias("share"))


def stays(events: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Admissions with the next close of the same visit and the stay length."""
    t = F.col("trigger")
    e = running(events.select("visit", "seq", "ts", "trigger"), ["visit"], ["ts", "seq"], time_chunk(F.col("ts"), chunk_seconds),
                closed_at=("next", F.when(t.isin(*CLOSING), F.col("ts"))))
    return e.filter(t == ADMIT).select("visit", "seq", F.col("ts").alias("admitted_at"), "closed_at",
                                       (F.unix_seconds("closed_at") - F.unix_seconds("ts")).alias("stay_seconds"))


def locations_in_force(events: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Every event with the location its visit was last placed in before it
    (as-of) and the trigger that preceded it."""
    t = F.col("trigger")
    return running(events, ["visit"], ["ts", "seq"], time_chunk(F.col("ts"), chunk_seconds),
                   location_before=("last", F.when(t.isin(ADMIT, TRANSFER), F.col("location"))),
                   prev=("last", F.struct("trigger"))).withColumn("previous_trigger", F.col("prev.trigger")).drop("prev")


def trigger_mix(events: DataFrame) -> DataFrame:
    return events.groupBy("trigger").agg(F.count("*").alias("n"))


def discharge_ratio(events: DataFrame) -> DataFrame:
    t = F.col("trigger")
    return events.agg(F.count_if(t == ADMIT).alias("admits"), F.count_if(t.isin(*CLOSING)).alias("closes")).withColumn(
        "ratio", F.when(F.col("admits") > 0, F.col("closes") / F.col("admits")))


def admissions_by_hour(events: DataFrame) -> DataFrame:
    """All 24 hours, zero-filled."""
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = events.filter(F.col("trigger") == ADMIT).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(n, "hour", "left").fillna(0, ["n"])


def resends(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Messages whose control id was seen before.

    The first arrival per id is a minimum, so a group of copies holding much of
    the table is reduced before the shuffle."""
    first = messages.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    return messages.join(first, key).filter(F.struct(*order) > F.col("__first")).drop("__first")


def first_arrivals(messages: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Idempotent intake: one message per control id, the first to arrive."""
    first = messages.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    return messages.join(first, key).filter(F.struct(*order) == F.col("__first")).drop("__first")


def identity_crosswalk(messages: DataFrame, identifiers: Column) -> DataFrame:
    """Distinct (facility number, enterprise id) pairs.

    ``identifiers``: ARRAY<STRUCT<id, authority, type>> of one message; both
    ids sit in the same message, so pairing needs no join."""
    of = lambda kind: F.filter("__ids", lambda x: (x["type"] == kind) & (x["id"] != ""))
    # materialised, else the filter that an explode implies would read the identifiers again
    both = materialise(messages.select(identifiers.alias("__ids")), "__kinds", F.struct(of("MR").alias("mr"), F.get(of("PI"), F.lit(0)).alias("pi")), [])
    mr = both.select(F.explode("__kinds.mr").alias("mr"), F.col("__kinds.pi").alias("pi"))
    return mr.filter(F.col("pi").isNotNull()).select(
        F.col("mr.authority").alias("facility"), F.col("mr.id").alias("mrn"), F.col("pi.id").alias("enterprise_id")).distinct()


def match_acks(messages: DataFrame, acks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Messages (control_id) with the code of their acknowledgement (refers_to);
    unanswered messages keep NULL.

    Several answers to one message are reduced to the first by ``order``
    before the join, so resent pairs never multiply."""
    first = F.min_by("code", F.struct(*order)) if order else F.min("code")
    one = acks.groupBy(F.col("refers_to").alias("control_id")).agg(first.alias("code"))
    return messages.join(one, "control_id", "left")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on either side and where they are missing."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"))
