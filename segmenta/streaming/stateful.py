"""Operators with their own state per key.

State is a few scalars per key.  Rows of one key within a micro-batch come
from many tasks and are sorted where they meet; how many that can be is
bounded by the size of the micro-batch (``maxFilesPerTrigger`` or
``maxBytesPerTrigger`` of the source), not by the history of the key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.outcome import PERMANENT, SENT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DELIVERY = "destination_id string, msg_id long, state string, attempts int, last_error string, dead_letter boolean, last_seq long"


def deliver(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Delivery outcomes as attempts arrive (update mode).

    Same columns in as the batch replay; attempts of one delivery must arrive
    in order across batches.  Keyed by delivery, not by destination, so a busy
    destination spreads out; which delivery is at the head of its queue is a
    minimum over the table of open deliveries."""

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status, error, last = state.get if state.exists else (0, "QUEUED", "", -1)
        rows = pd.concat(list(frames)).sort_values("attempt_seq")
        for seq, outcome, text in zip(rows["attempt_seq"], rows["outcome"], rows["error"]):
            if status != "QUEUED" or seq <= last:
                continue
            last = int(seq)
            if outcome == SENT:
                status, error = "SENT", ""
                continue
            n, error = n + 1, text
            if outcome == PERMANENT or (max_attempts != -1 and n >= max_attempts):
                status = "ERROR"
        state.update((n, status, error, last))
        yield pd.DataFrame({"destination_id": [key[0]], "msg_id": [key[1]], "state": [status], "attempts": [n],
                            "last_error": [error], "dead_letter": [status == "ERROR"], "last_seq": [last]})

    return attempts.groupBy("destination_id", "msg_id").applyInPandasWithState(
        fold, _DELIVERY, "attempts int, status string, error string, last long", "update", GroupStateTimeout.NoTimeout)


_ALERT = "visit string, seq long, trigger string, breach string"


def lifecycle_alerts(events: DataFrame) -> DataFrame:
    """Breaches of the visit lifecycle as events arrive (append mode)."""

    def check(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted, closed, last = state.get if state.exists else (False, False, None)
        rows, out = pd.concat(list(frames)).sort_values("seq"), []
        for seq, at, t in zip(rows["seq"], rows["ts"], rows["trigger"]):
            if t == "A01":
                if admitted:
                    out.append((seq, t, "admitted twice"))
                admitted = True
            elif t in ("A02", "A08", "A03", "A11"):
                if not admitted:
                    out.append((seq, t, "before admission"))
                if closed:
                    out.append((seq, t, "closed twice" if t in ("A03", "A11") else "after close"))
                closed = closed or t in ("A03", "A11")
            if last is not None and at.value < last:
                out.append((seq, t, "backwards in time"))
            last = at.value
        state.update((admitted, closed, last))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["visit", "seq", "trigger", "breach"])

    return events.select("visit", "seq", "ts", "trigger").groupBy("visit").applyInPandasWithState(
        check, _ALERT, "admitted boolean, closed boolean, last long", "append", GroupStateTimeout.NoTimeout)


def live_locations(events: DataFrame) -> DataFrame:
    """Latest trigger and location per visit (update mode): the census of the
    moment is a count over it."""
    return events.groupBy("visit").agg(F.max(F.struct("seq", "trigger", "location")).alias("l")).select(
        "visit", F.col("l.trigger").alias("trigger"), F.col("l.location").alias("location"))
