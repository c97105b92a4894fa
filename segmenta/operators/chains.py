"""Following pointers: merge chains and replay lineage.

Pointer doubling over a frontier: after k rounds every record that is still open points 2^k steps ahead, and every record
within 2^k steps of its chain's end is resolved and set aside.  A round rewrites the open records alone, so rounds shrink;
resolved ones are only read.  A round that resolves nothing leaves the records that lead into cycles: they alone are
doubled on until only cycle members are pointed to, which then are the ends of the rest.

Each round is written out with a reliable checkpoint, so the plan stays flat and lost executors cost one round.  Both join
sides are keyed by record id, unique on the build side; a survivor that a third of all records lead to is a hot key on
the probe side only, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def _ends(links: DataFrame, on_round: Callable[[int], None]) -> tuple[list[DataFrame], DataFrame | None]:
    """(parts of (id, to) with ``to`` the chain's end, ids that lead into cycles) of stored links(id, to)."""
    left, parts, open_before = links, [], links.count()
    while open_before:
        on_round(open_before)
        ahead = reduce(DataFrame.unionByName, (p.withColumn("ended", F.lit(True)) for p in parts), left.withColumn("ended", F.lit(False))) \
            .select(F.col("id").alias("__n"), F.col("to").alias("__to"), "ended")
        # what points to nothing that points on has its end
        step = durable(left.join(ahead, left["to"] == F.col("__n"), "left").select(
            "id", F.coalesce("__to", "to").alias("to"), F.coalesce("ended", F.lit(True)).alias("ended")))
        parts.append(step.filter("ended").drop("ended"))
        left = step.filter("not ended").drop("ended")
        still = left.count()
        if still == open_before:
            return parts, left.select("id")
        open_before = still
    return parts, None


def _cycle_members(links: DataFrame) -> DataFrame:
    """The ids on cycles, of links that all lead into cycles."""
    step, total, hops = links, links.count(), 1
    while hops < total:
        ahead = step.select(F.col("id").alias("__n"), F.col("to").alias("__to"))
        step = durable(step.join(ahead, step["to"] == F.col("__n")).select("id", F.col("__to").alias("to")))
        hops *= 2
    # so many steps ahead lies a cycle, and all of its members are met because the jump permutes them
    return step.select(F.col("to").alias("id")).distinct()


def follow(df: DataFrame, id_col: str, next_col: str, on_round: Callable[[int], None] = lambda n: None) -> DataFrame:
    """(id, survivor) for every row; rows without a pointer survive themselves.

    Cycles are safe: a record on a cycle is its own survivor, and a chain that leads into a cycle ends at the first record
    of the cycle it meets.  ``on_round`` is told how many records a round has to look at."""
    # read once: ``df`` may be parsed from text
    known = durable(df.select(F.col(id_col).alias("id"), F.col(next_col).alias("to")))
    links = known.filter(F.col("to").isNotNull())
    own = known.filter(F.col("to").isNull()).select("id", F.col("id").alias("to"))
    parts, circling = _ends(links, on_round)
    parts = [own, *parts]
    if circling is not None:
        left = durable(links.join(circling, "id", "left_semi"))
        members = durable(_cycle_members(left))
        tails, _ = _ends(durable(left.join(members, "id", "left_anti")), on_round)
        parts += [members.select("id", F.col("id").alias("to")), *tails]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("to", "survivor")


def lineage(messages: DataFrame) -> DataFrame:
    """(msg_id, original_id) along ``replay_of``."""
    return follow(messages, "msg_id", "replay_of").select(
        F.col("id").alias("msg_id"), F.col("survivor").alias("original_id"))
