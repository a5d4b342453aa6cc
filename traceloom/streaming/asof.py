"""What was known at a time: facts kept by event time and by the time they became known.

The stream keeps every fact of a case in state for `keep`.  The state itself can be read while the
stream runs, for any time of knowledge and any time of validity that are no older than that.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_NEWS = "case_id string, event long, known long, status string"
_News = Row(*(part.strip().split(" ")[0] for part in _NEWS.split(",")))


class _History(StatefulProcessor):
    """The facts of one case, (event time, id, time of knowledge, status), and the newest event time told.

    Every access to state is a message to the JVM: a call reads the facts of a known case once and
    adds all new ones at once.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getListState("facts", "event long, id string, known long, status string")
        self.told = handle.getValueState("told", "event long, id string, sweep long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = self.told.get()
        event, id, sweep = told or (None, None, None)
        held = {(e, i): (known, status) for e, i, known, status in self.facts.get()} if told else {}
        fresh: dict[tuple, tuple] = {}
        newest = None
        for row in rows:
            e, i, known, status = row["event"], row["id"], row["known"], row["status"]
            if e is None or known is None:
                continue  # it is known at no time
            before = fresh.get((e, i)) or held.get((e, i))
            if before and before[0] <= known:
                continue  # known before
            fresh[e, i] = (known, status)
            if event is None or (e, i or "") > (event, id or ""):
                event, id, newest = e, i, (key[0], e, known, status)
            if sweep is None:
                sweep = (known + self.keep) // 1000 + 1
                self.handle.registerTimer(sweep)
        if any(fact in held for fact in fresh):  # known earlier than was thought
            self.facts.put([(*k, *v) for k, v in (held | fresh).items()])
        elif fresh:
            self.facts.appendList([(*k, *v) for k, v in fresh.items()])
        if fresh or not told:
            self.told.update((event, id, sweep))
        return iter([_News(*newest)] if newest else ())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 - self.keep
        facts = sorted(self.facts.get(), key=lambda f: (f[0], f[1] or ""), reverse=True)
        answered = False
        youngest = None
        kept = []
        for event, id, known, status in facts:
            # of the old ones only those stay that a time within `keep` may still ask for
            if answered and event < horizon:
                continue
            kept.append((event, id, known, status))
            answered = answered or (event < horizon and known <= horizon)
            if event >= horizon or known > horizon:
                until = max(event, known)
                youngest = until if youngest is None else min(youngest, until)
        if len(kept) < len(facts):
            self.facts.put(kept)
        event, id, _ = self.told.get()
        sweep = None if youngest is None else (youngest + self.keep) // 1000 + 1
        if sweep is not None:
            self.handle.registerTimer(sweep)
        self.told.update((event, id, sweep))
        return iter(())

    def close(self) -> None:
        pass


def remember(facts: DataFrame, keep_days: int = 400, watermark: str = "0 seconds") -> DataFrame:
    """Keep facts (case_id, id, event_at, known_at, status) in state; emits a case's status when a newer one becomes known.

    The clock is known_at.  Repeated facts keep the first time they were known.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = facts.withWatermark("known_at", watermark).select(
        "case_id", "id", "status", "known_at", F.unix_micros("event_at").alias("event"), F.unix_micros("known_at").alias("known")
    )
    got = rows.groupBy("case_id").transformWithState(
        statefulProcessor=_History(keep_days * 86_400_000_000), outputStructType=_NEWS, outputMode="Append", timeMode="EventTime"
    )
    return got.select("case_id", F.timestamp_micros("event").alias("event_at"), F.timestamp_micros("known").alias("known_at"), "status")


def facts_known(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(case_id, id, event_at, known_at, status) from the state of `remember` after a micro-batch, by default the last."""
    reader = spark.read.format("statestore").option("stateVarName", "facts")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint)
    return state.select(
        F.col("key.case_id").alias("case_id"),
        F.col("list_element.id").alias("id"),
        F.timestamp_micros("list_element.event").alias("event_at"),
        F.timestamp_micros("list_element.known").alias("known_at"),
        F.col("list_element.status").alias("status"),
    )


def as_of(facts: DataFrame, known_by: Column, valid_at: Column | None = None) -> DataFrame:
    """Per case the status of its latest event, from what was known by a time, of events up to valid_at."""
    told = facts.where(F.col("known_at") <= known_by)
    if valid_at is not None:
        told = told.where(F.col("event_at") <= valid_at)
    latest = F.max_by(F.struct("status", "event_at"), F.struct("event_at", "id"))
    got = told.groupBy("case_id").agg(latest.alias("x"), F.count(F.lit(1)).alias("facts"))
    return got.select("case_id", "x.status", "x.event_at", "facts")
