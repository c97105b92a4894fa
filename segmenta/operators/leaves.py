"""Leaves of parsed messages and the structural difference of two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import materialise
from ..functions.delimited import DelimitedSpec, Parsed, split_on
from ..functions.trees import Tree


def flatten_delimited(df: DataFrame, keys: list[str], spec: DelimitedSpec, msg: str = "msg") -> DataFrame:
    """keys, ord, path, value: one row per non-empty leaf.

    A chain of generators over the row's own arrays; empty pieces are dropped
    at every level before the next one is expanded, and nothing shuffles.
    """
    p = Parsed(msg, spec)
    out = df.select(*keys, F.struct(p.d.alias("d"), p.bytewise.alias("bytewise")).alias("m"), p.segs.alias("segs"),
                    F.explode(p.occurrences()).alias("o"))
    fields = F.get(F.col("segs"), F.col("o.pos"))
    out = out.select(*keys, "m", F.col("o.pos").alias("pos"), F.col("o.occ").alias("occ"), fields[0].alias("seg"),
                     F.posexplode(fields).alias("f", "ftext"))
    out = out.filter((F.col("f") > 0) & (F.col("ftext") != ""))
    d = lambda role: F.col("m.d")[role]
    raw = F.col("seg").isin(*spec.headers) & (F.col("f") <= spec.header_raw)
    whole = lambda text, sep: F.when(raw, F.array(text)).otherwise(split_on(text, sep))
    out = out.select("*", F.posexplode(whole(F.col("ftext"), d("rep"))).alias("r", "rtext")).filter(F.col("rtext") != "")
    comps = whole(F.col("rtext"), d("comp"))
    has_sub = F.contains(F.col("rtext"), d("sub")) if spec.has_sub else F.lit(False)
    leaf_rep = raw | ~(F.contains(F.col("rtext"), d("comp")) | has_sub)
    out = out.select(*keys, "m", "seg", "pos", "occ", "f", "r", leaf_rep.alias("leaf_rep"), raw.alias("raw"),
                     F.posexplode(comps).alias("c", "ctext")).filter(F.col("ctext") != "")
    raw = F.col("raw")
    if spec.has_sub:
        out = out.select("*", (raw | ~F.contains(F.col("ctext"), d("sub"))).alias("leaf_comp"),
                         F.posexplode(F.when(raw, F.array("ctext")).otherwise(split_on(F.col("ctext"), d("sub")))
                                      ).alias("s", "text")).filter(F.col("text") != "")
    else:
        out = out.select("*", F.lit(True).alias("leaf_comp"), F.lit(0).alias("s"), F.col("ctext").alias("text"))
    index = lambda c: F.when(c > 1, F.concat(F.lit("["), c.cast("string"), F.lit("]"))).otherwise(F.lit(""))
    dotted = lambda cond, c: F.when(cond, F.lit("")).otherwise(F.concat(F.lit("."), (c + 1).cast("string")))
    path = F.concat(F.col("seg"), index(F.col("occ")), F.lit("-"), F.col("f").cast("string"), index(F.col("r") + 1),
                    dotted(F.col("leaf_rep"), F.col("c")), dotted(F.col("leaf_comp"), F.col("s")))
    shown = Parsed(None, spec, {"error": F.lit(None), "bytewise": F.col("m.bytewise"), "d": F.col("m.d"),
                                "segs": F.lit(None)})._show(F.col("text"))
    value = F.when(raw, F.col("text")).otherwise(shown)
    out = out.select(*keys, F.array("pos", "f", "r", "c", "s").alias("ord"), path.alias("path"), value.alias("value"))
    return out.filter(F.col("value") != "")


def flatten_tree(df: DataFrame, keys: list[str], fmt: str, msg: str = "msg") -> DataFrame:
    """keys, ord, path, value (and kind) of a parsed csv, json or xml payload."""
    out = df.select(*keys, F.posexplode(Tree(msg, fmt).leaves()).alias("i", "x"))
    return out.select(*keys, F.array("i").alias("ord"), F.col("x.path").alias("path"), F.col("x.value").alias("value"),
                      F.col("x.kind").alias("kind"))


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, op, from, to, side, ord.

    One shuffle on (keys, path): both sides are stacked and the last value per
    path and side is kept by an aggregate that combines before the exchange.
    Document order is (side, ord): additions and changes first, then removals.
    """
    cols = [*keys, "path", "ord", "value"]
    both = before.select(*cols, F.lit(0).alias("s")).unionByName(after.select(*cols, F.lit(1).alias("s")))
    pick = lambda s: F.max(F.when(F.col("s") == s, F.struct("ord", "value")))
    got = both.groupBy(*keys, "path").agg(pick(0).alias("a"), pick(1).alias("b"))
    op = (F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
          .when(F.col("a.value") != F.col("b.value"), "changed"))
    return got.withColumn("op", op).filter(F.col("op").isNotNull()).select(
        *keys, "path", "op", F.col("a.value").alias("from"), F.col("b.value").alias("to"),
        F.when(F.col("op") == "removed", 1).otherwise(0).alias("side"),
        F.coalesce("b.ord", "a.ord").alias("ord"))


def added_removed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Paths present on one side only."""
    return diff(before, after, keys).filter(F.col("op") != "changed").select(*keys, "path", "op")


def rebuild(segments: DataFrame, keys: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """Messages from segment rows: an ordered aggregate per message."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return segments.groupBy(*keys).agg(
        F.concat(F.array_join(F.transform(parts, lambda s: s[text]), "\r"), F.lit("\r")).alias("raw"))


def segment_rows(df: DataFrame, keys: list[str], spec: DelimitedSpec, msg: str = "msg",
                 name: str | None = None, outer: bool = False) -> DataFrame:
    """One row per segment: keys, pos, fields (field n at index n).

    A key that is the message itself stays for ``Parsed.at`` alone: its segments are NULL, else each row would hold them
    all and a message grow with the square of its length."""
    p = Parsed(msg, spec)
    segs = p.segs if name is None else p.segments(name)
    explode = F.posexplode_outer if outer else F.posexplode
    if msg in keys:
        df = df.withColumn("__segs", segs).withColumn(msg, p._with(segs=F.lit(None).cast("array<array<string>>")).col)
        segs = F.col("__segs")
    # materialised, else the filter that an explode implies would search the message again
    return materialise(df, "__segs", segs, keys).select(*keys, explode("__segs").alias("pos", "fields"))


def invalid_and_valid(df: DataFrame, data_type: str, msg: str = "msg") -> tuple[DataFrame, DataFrame]:
    """(invalid, valid); invalid rows carry ``error_text``."""
    error = F.col(f"{msg}.error")
    bad = df.filter(error.isNotNull()).withColumn("error_text", F.concat(F.lit(f"parse ({data_type}): "), error))
    return bad, df.filter(error.isNull())
