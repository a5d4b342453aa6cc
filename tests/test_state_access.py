"""How often the stateful processors go to the state: each access is a message to the JVM."""

from collections import Counter

import pytest
from pyspark.sql import Row

from traceloom.streaming import asof, timers
from traceloom.streaming import detector as det
from traceloom.streaming import monitors as mo

MINUTE = 60_000_000


class State:
    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls["get"] += 1
        return self.held

    def update(self, value):
        self.calls["write"] += 1
        self.held = value


class ListState(State):
    def get(self):
        self.calls["get"] += 1
        return iter(self.held or [])

    def put(self, rows):
        self.calls["write"] += 1
        self.held = list(rows)

    def appendList(self, rows):
        self.calls["write"] += 1
        self.held = [*(self.held or []), *rows]

    def clear(self):
        self.calls["write"] += 1
        self.held = None


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getValueState(self, name, schema):
        return State(self.calls)

    def getListState(self, name, schema):
        return ListState(self.calls)

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def started(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def pending(n):
    return Row(at=n * MINUTE, event=n * MINUTE, snapshot_id=f"s{n}", delivery=f"d{n}", retry=n % 2 == 1, superseding=False, base="pending", why="w", stability="pending")


@pytest.mark.parametrize("allowed", [0, 30])
def test_the_detector_reads_and_writes_its_state_once_a_call(allowed):
    detector = det._Detector(180 * MINUTE, allowed * MINUTE, 7 * 1440 * MINUTE, "abstain", None)
    handle = started(detector)
    told = list(detector.handleInputRows(("c",), iter([pending(n) for n in range(200)]), Times(0)))
    told += detector.handleInputRows(("c",), iter([pending(n) for n in range(200, 400)]), Times(0))
    assert [r.snapshot_id for r in told if r.outcome == "pending"] == [f"s{n}" for n in range(400)]
    # case, recent and seen read and written, and the timers of the last pending state and of the first sweep
    assert handle.calls["get"] <= 6 and handle.calls["write"] <= 6 and handle.calls["timer"] <= 3
    due = (399 + 180) * MINUTE
    (expired,) = detector.handleExpiredTimer(("c",), Times(due // 1000 + 1), Times(due // 1000 + 1))
    assert (expired.snapshot_id, expired.outcome, expired.reasons) == ("s399", "abstain", det.EXPIRED)


def test_a_history_is_read_once_and_added_to_at_once():
    history = asof._History(400 * 86_400_000_000)
    handle = started(history)
    fact = lambda n, known, status: Row(event=n, id=f"{n}", known=known, status=status)
    list(history.handleInputRows(("c",), iter([fact(n, 1000 + n, "a") for n in range(300)]), Times(0)))
    again = [fact(n, 2000 + n, "later") for n in range(300)] + [fact(7, 5, "earlier"), fact(300, 9, "b"), fact(301, None, "never")]
    (news,) = history.handleInputRows(("c",), iter(again), Times(0))
    assert (news.event, news.status) == (300, "b")
    held = {f[0]: f[2:] for f in history.facts.held}
    assert len(history.facts.held) == 301 and held[7] == (5, "earlier") and held[8] == (1008, "a") and held[300] == (9, "b")
    assert handle.calls["get"] <= 4 and handle.calls["write"] <= 4 and handle.calls["timer"] == 1


def test_drafts_that_are_over_go_with_one_timer():
    drafts = timers._Drafts(8 * 60 * MINUTE)
    handle = started(drafts)
    list(drafts.handleInputRows(("u",), iter([Row(at=n * MINUTE, id=f"{n}", kind=timers.OPENED) for n in range(600)]), Times(0)))
    assert handle.calls["timer"] == 1
    now = Times((8 * 60 + 499) * 60_000 + 1)
    found = list(drafts.handleExpiredTimer(("u",), now, Times(min(handle.timers))))
    assert [r.draft_id for r in found] == [f"{n}" for n in range(500)] and len(drafts.marks.held) == 100
    assert handle.calls["timer"] == 2 and max(handle.timers) == (8 * 60 + 500) * 60_000 + 1


def test_state_has_partitions_by_the_rows_of_a_batch(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with mo.state_store(spark, rows=100 * mo.STATE_ROWS):
        assert spark.conf.get(name) == "100"
    with mo.state_store(spark, rows=10):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before
