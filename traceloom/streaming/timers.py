"""Deadlines on streams: stuck cases and expired drafts, by event-time timers.

A timer fires when the watermark has passed a deadline, so all rows that could still meet it have
arrived, in whatever order.  State goes when nothing is left to wait for.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROGRESS, END = "progress", "end"
OPENED, DECIDED = "opened", "decided"


def _timer(deadline: int) -> int:
    """Milliseconds at which a deadline in microseconds has passed."""
    return -(-deadline // 1000) + 1


def _row(names: str) -> Row:
    return Row(*(part.strip().split(" ")[0] for part in names.split(",")))


_STUCK = "case_id string, progress long, stuck long"
_Stuck = _row(_STUCK)


class _Idle(StatefulProcessor):
    """One case: its spans of activity without a pause over the limit, merged as rows come in any order.

    A span is (first, last, ended).  Its timer is at last + limit; a row within the limit of a span
    joins it and moves the timer, a row between two spans can make them one.  A span that is ended by
    a closing row leaves without a word.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first long, last long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        spans = [tuple(s) for s in self.spans.get()]
        timers = {_timer(last + self.limit) for _, last, _ in spans}
        for row in rows:
            at, end = row["at"], row["kind"] == END
            joined, rest = (at, at, end), []
            for first, last, ended in spans:
                if joined[0] - self.limit <= last and first <= joined[1] + self.limit:
                    late, early = max((joined[1], joined[2]), (last, ended)), min(joined[0], first)
                    joined = (early, *late)
                else:
                    rest.append((first, last, ended))
            spans = [*rest, joined]
        wanted = {_timer(last + self.limit) for _, last, _ in spans}
        for at in sorted(timers - wanted):
            self.handle.deleteTimer(at)
        for at in sorted(wanted - timers):
            self.handle.registerTimer(at)
        self.spans.put(spans)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(s) for s in self.spans.get()]
        over = [s for s in spans if _timer(s[1] + self.limit) <= now]
        left = [s for s in spans if _timer(s[1] + self.limit) > now]
        if left:
            self.spans.put(left)
        elif spans:
            self.spans.clear()
        return iter([_Stuck(key[0], last, last + self.limit) for _, last, ended in sorted(over) if not ended])

    def close(self) -> None:
        pass


def stuck(events: DataFrame, progress: tuple[str, ...], terminal: tuple[str, ...], hours: float, watermark: str = "0 seconds") -> DataFrame:
    """(case_id, progress_at, stuck_at): open cases without progress for so many hours, when that time is over.

    Needs case_id, event_type and event_at, and the RocksDB state store.  A case can be stuck again
    after it has moved on; one that has ended is not stuck.  Rows may be as late as the watermark says.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    kind = F.when(F.col("event_type").isin(*progress), PROGRESS).when(F.col("event_type").isin(*terminal), END)
    rows = events.withWatermark("event_at", watermark).withColumn("kind", kind).where(F.col("kind").isNotNull())
    rows = rows.select("case_id", "event_at", "kind", F.unix_micros("event_at").alias("at"))
    got = rows.groupBy("case_id").transformWithState(
        statefulProcessor=_Idle(int(hours * 3_600_000_000)), outputStructType=_STUCK, outputMode="Append", timeMode="EventTime"
    )
    return got.select("case_id", F.timestamp_micros("progress").alias("progress_at"), F.timestamp_micros("stuck").alias("stuck_at"))


_EXPIRED = "owner string, draft_id string, created long, expires long"
_Expired = _row(_EXPIRED)


class _Drafts(StatefulProcessor):
    """The drafts of one owner until their time is over, and the decisions on the latest of them.

    One timer, for the earliest of them; when it fires, all that are over by then go together.
    """

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getListState("marks", "at long, id string, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        marks = [(row["at"], row["id"], row["kind"]) for row in rows if row["at"] is not None]
        if marks:
            # a decision may come before its draft does, and is held as long
            self.handle.registerTimer(_timer(min(at for at, _, _ in marks) + self.life))
            self.marks.appendList(marks)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        marks = sorted((tuple(m) for m in self.marks.get()), key=lambda m: (m[0], m[1] or "", m[2]))
        if not marks:
            return iter(())
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        found, left = [], []
        for i, (at, id, kind) in enumerate(marks):
            if _timer(at + self.life) > now:
                left.append((at, id, kind))
            elif kind == OPENED:
                after = marks[i + 1] if i + 1 < len(marks) else None
                if after is None or after[2] == OPENED or after[0] >= at + self.life:
                    found.append(_Expired(key[0], id, at, at + self.life))
        if len(left) < len(marks):
            if left:
                self.marks.put(left)
                self.handle.registerTimer(_timer(left[0][0] + self.life))
            else:
                self.marks.clear()
        return iter(found)

    def close(self) -> None:
        pass


def expired_drafts(marks: DataFrame, hours: float, watermark: str = "0 seconds") -> DataFrame:
    """(owner, draft_id, created_at, expires_at): drafts that nobody decided on before their time was over.

    marks has owner, id, kind (`opened` or `decided`) and at; a decision belongs to the owner's latest
    draft before it.  Needs the RocksDB state store.  At the deadline itself a draft has expired.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = marks.withWatermark("at", watermark).select("owner", "id", "kind", F.col("at").alias("event_time"), F.unix_micros("at").alias("at"))
    got = rows.groupBy("owner").transformWithState(
        statefulProcessor=_Drafts(int(hours * 3_600_000_000)), outputStructType=_EXPIRED, outputMode="Append", timeMode="EventTime"
    )
    return got.select("owner", "draft_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("expires").alias("expires_at"))
