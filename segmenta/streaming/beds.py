"""The bed map as a stream: who lies where, corrected when events come late.

Every bed keeps what it was when the watermark last passed, and the acts (claims and releases) since then in a map by their
order.  A micro-batch adds its acts and folds the map anew, so acts may come in any order within ``late``.  A timer fires
when the watermark has passed a bed's acts: they go into the bed's settled state, and a bed that is free and has no acts
left loses its state.  So state is bounded by the beds in use and the events within ``late``.

Needs the RocksDB state store (``ROCKSDB``); ``state_session`` gives a session that has it and leaves the caller's alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.feeds import bed_events

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def fold(holder, occupied: bool, acts: list) -> tuple:
    """(holder, occupied) after acts (kind, visit) in order: a claim takes the bed, only its holder's release frees it."""
    for kind, visit in acts:
        if kind == "claim":
            holder, occupied = visit, True
        elif visit == holder:
            occupied = False
    return holder, occupied


class BedMap(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "holder string, occupied boolean")
        self.acts = handle.getMapState("acts", "place long", "kind string, visit string, at long")

    def _state(self) -> tuple[tuple, list]:
        settled = tuple(self.settled.get()) if self.settled.exists() else (None, False)
        acts = sorted(((k[0], *v) for k, v in self.acts.iterator()), key=lambda a: a[0]) if self.acts.exists() else []
        return settled, acts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        latest = 0
        for r in rows:
            self.acts.updateValue((r.place,), (r.kind, r.visit, r.at))
            latest = max(latest, r.at)
        self.handle.registerTimer(latest + 1)
        settled, acts = self._state()
        holder, occupied = fold(*settled, [a[1:3] for a in acts])
        yield Row(bed=key[0], visit=holder if occupied else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        (holder, occupied), acts = self._state()
        done = 0
        while done < len(acts) and acts[done][3] <= passed:  # what comes before an open act is settled, nothing behind it
            self.acts.removeKey((acts[done][0],))
            done += 1
        holder, occupied = fold(holder, occupied, [a[1:3] for a in acts[:done]])
        if done < len(acts):
            self.handle.registerTimer(max(max(a[3] for a in acts[done:]), passed) + 1)
        if occupied or done < len(acts):
            self.settled.update((holder, occupied))
        else:
            self.settled.clear()
        return iter(())

    def close(self) -> None:
        pass


def bed_map(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(bed, visit): beds as they change; visit is NULL for a bed that became free.  Update mode, streams only."""
    acts = bed_events(events.withWatermark("ts", late))
    keyed = acts.select("bed", "ts", (F.col("seq") * 2 + F.col("step")).alias("place"), "kind", "visit", F.unix_millis("ts").alias("at"))
    return keyed.groupBy("bed").transformWithState(BedMap(), "bed string, visit string", "Update", "EventTime")


def keep_bed_map(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour", available_now: bool = False) -> StreamingQuery:
    """Run the map; a batch's changes are one folder, written over when the batch is repeated."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = bed_map(events, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_beds(spark: SparkSession, path: str) -> DataFrame:
    """(bed, visit) of the beds that are taken after the last batch."""
    changes = spark.read.schema("bed string, visit string, batch long").parquet(path)
    return changes.groupBy("bed").agg(F.max_by(F.struct("visit"), "batch").alias("last")).select("bed", F.col("last.visit").alias("visit")).filter("visit is not null")
