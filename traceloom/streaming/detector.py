"""Keyed detector over intake snapshots: one decision list, a batch and a streaming form.

`decide` holds everything that depends on the snapshot alone and is plain column
work in both forms.  What depends on the case's past (repeated deliveries, an
active recommendation, a running confirmation timer) is done with ordered scans
in the batch form and with keyed state and event-time timers in the stream.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructType

from ..functions.calendar import plus_micros
from ..functions.ordered import scan
from ..operators.contracts import SNAPSHOT_ORDER, effective_form, field_of
from ..session import Scale
from ..spec import DetectorSpec

OUTPUT = (
    "case_id string, snapshot_id string, evaluated_at timestamp, outcome string, "
    "reasons string, stability string, due_at timestamp, late boolean"
)
COLUMNS = tuple(part.strip().split(" ")[0] for part in OUTPUT.split(","))
#: Goes up when the detector would judge the same rows differently or keeps its state in another form.
VERSION = "keyed-detector-3"
EXPIRED = "pending_update_not_confirmed"
REPEATED = "duplicate_delivery_suppressed"
LATE = "late_snapshot"
#: Outcome of a correction that takes an expiry back: what confirmed it in time had not arrived yet.
WITHDRAWN = "withdrawn"


def decide(snapshots: DataFrame, forms: DataFrame, spec: DetectorSpec) -> DataFrame:
    """Stateless part: adds `base` (abstain, pending, resolved, recommend, observe_only), why and how sure."""
    rows = effective_form(snapshots, forms).withColumn("_doc", field_of(spec.document_field))
    state, applies = F.col("_doc.state"), F.col("_doc.applicable")
    unsupported = (
        F.col("form_no").isNull()
        | ~F.col("form_version").isin(*spec.form_versions)
        | ~F.col("source_system").isin(*spec.source_systems)
        | (F.col("requirements_contract_version") != spec.contract_version)
    )
    positive = state.isin("absent", "verification_required")
    reviewing = F.lit(spec.suppress_under_review) & F.col("manual_review_state").isin("started", "completed")
    warned = F.lit(spec.suppress_warned) & (F.size("source_warning_codes") > 0)
    explicit = F.when(state == "absent", "required_supporting_document_explicitly_absent").otherwise(
        "administrative_verification_explicitly_required"
    )
    rules: list[tuple[Column, Column | str, Column | str, str]] = [
        (unsupported, "abstain", "unsupported_or_mismatched_requirements_contract", "unsupported"),
        (F.col("conflict_status") == "detected", "abstain", "conflicting_source_state", "conflicting"),
        (F.col("freshness") != "fresh", "abstain", "source_state_not_fresh", "stale"),
        (applies.isNull(), "abstain", "document_applicability_unknown", "unknown"),
        (state == "unknown", "abstain", "required_document_state_uncertain", "unknown"),
        (state == "unsupported", "abstain", "required_document_state_uncertain", "unsupported"),
        (state == "pending_source_update", "pending", "pending_source_update", "pending"),
        (state.isin("present", "not_applicable"), "resolved", "current_source_state_resolved", "resolved"),
        (state == "conflicting", "abstain", "field_level_source_conflict", "conflicting"),
        (state == "stale", "abstain", "field_level_stale_state", "stale"),
        (
            positive & reviewing,
            "observe_only",
            F.concat_ws(",", explicit, F.lit("manual_review_already_underway")),
            "stable_explicit_absence",
        ),
        (
            positive & warned,
            "observe_only",
            F.concat_ws(",", explicit, F.lit("overlapping_source_warning")),
            "stable_explicit_absence",
        ),
        (positive, "recommend", explicit, "stable_explicit_absence"),
    ]

    def chain(pick: int, default: str) -> Column:
        out = None
        for rule in rules:
            value = rule[pick]
            out = F.when(rule[0], value) if out is None else out.when(rule[0], value)
        return out.otherwise(default)

    return rows.select(
        "case_id",
        "snapshot_id",
        "available_at",
        F.col(spec.event_time).alias("event_at"),
        F.concat_ws("|", "source_record_identifier", F.col("source_record_version").cast("string")).alias(
            "delivery"
        ),
        (F.col("update_type") == "retry").alias("retry"),
        F.col("superseded_snapshot_id").isNotNull().alias("superseding"),
        chain(1, "abstain").alias("base"),
        chain(2, "unhandled_administrative_state").alias("why"),
        chain(3, "unknown").alias("stability"),
    )


def _placed(rows: DataFrame, spec: DetectorSpec, scale: Scale) -> DataFrame:
    """Adds mark (the case's newest event time before this arrival), late, beyond (the allowance) and `at`, its place in time.

    A row within the allowance takes its place by event time; one beyond it counts from the mark on.
    """
    if spec.event_time == "available_at":  # arrivals are in order of this time by definition
        return rows.withColumns({"mark": F.lit(None).cast("timestamp"), "late": F.lit(False), "beyond": F.lit(False), "at": F.col("available_at")})
    rows = scan(rows, ["case_id"], SNAPSHOT_ORDER, scale, peak={"_newest": F.col("event_at")})
    rows = scan(rows, ["case_id"], SNAPSHOT_ORDER, scale, previous={"mark": F.col("_newest")})
    late = F.coalesce(F.col("event_at") < F.col("mark"), F.lit(False))
    horizon = plus_micros(F.col("mark"), F.lit(-spec.allowed_lateness_minutes * 60_000_000))
    beyond = F.coalesce(F.col("event_at") < horizon, F.lit(False))
    return rows.withColumns({"late": late, "beyond": beyond, "at": F.when(beyond, F.col("mark")).otherwise(F.col("event_at"))})


def detect(
    snapshots: DataFrame,
    forms: DataFrame,
    spec: DetectorSpec,
    scale: Scale,
    as_of: Column | None = None,
) -> DataFrame:
    """Batch form.  Timers still running at `as_of` are not reported as expired.

    Rows are judged in the order of their place in time (`spec.event_time`, see `_placed`); late ones
    beyond the allowance abstain or are applied with a warning, as the policy says.
    """
    rows = _placed(decide(snapshots, forms, spec), spec, scale)
    order = ["at", *SNAPSHOT_ORDER]
    aside = None
    if spec.late_policy == "abstain" and spec.event_time != "available_at":
        aside, rows = rows.where("beyond"), rows.where("not beyond")
    counted = scan(rows, ["case_id", "delivery"], order, scale, previous={"_copy_at": F.col("at")})
    known_for = F.lit(spec.retry_days * 86_400_000_000)
    repeated = F.col("retry") & (F.unix_micros("at") - F.unix_micros("_copy_at") <= known_for)
    counted = counted.withColumn("repeated", F.coalesce(repeated, F.lit(False)))
    live = ~F.col("repeated")
    positive = live & F.col("base").isin("recommend", "observe_only")
    resets = live & (F.col("base") == "resolved") & F.col("superseding")
    marked = scan(
        counted,
        ["case_id"],
        order,
        scale,
        carry={"_mark": F.when(positive, 1).when(resets, 0)},
        highest={"_last": F.col("at")},
    )
    known = scan(marked, ["case_id"], order, scale, previous={"_active": F.col("_mark")})
    retract = resets & (F.col("_active") == 1)
    outcome = (
        F.when(F.col("repeated"), "no_recommendation")
        .when(F.coalesce(retract, F.lit(False)), "retract")
        .when(F.col("base") == "resolved", "no_recommendation")
        .otherwise(F.col("base"))
    )
    known = known.withColumn("outcome", outcome)
    # a timer ends with the next outcome that concludes or replaces it
    ends = ~F.col("repeated") & F.col("outcome").isin("recommend", "observe_only", "retract", "pending")
    timed = scan(
        known,
        ["case_id"],
        order,
        scale,
        ahead={"_ends_at": F.when(ends, F.col("at"))},
    ).withColumn("due", plus_micros(F.col("at"), F.lit(spec.confirm_minutes * 60_000_000)))
    is_pending = F.col("outcome") == "pending"
    expired = is_pending & (F.col("_ends_at").isNull() | (F.col("_ends_at") > F.col("due")))
    if as_of is not None:
        expired = expired & ((F.col("due") < as_of) | (F.col("_last") > F.col("due")))
    warned = F.col("beyond") & ~F.col("repeated")
    own = F.struct(
        F.col("available_at").alias("evaluated_at"),
        F.col("outcome").alias("outcome"),
        F.when(F.col("repeated"), REPEATED).when(warned, F.concat_ws(",", "why", F.lit(LATE))).otherwise(F.col("why")).alias("reasons"),
        F.when(F.col("repeated"), "superseded").otherwise(F.col("stability")).alias("stability"),
        F.when(is_pending, F.col("due")).alias("due_at"),
        F.col("late"),
    )
    timeout = F.when(
        expired,
        F.struct(
            F.col("due").alias("evaluated_at"),
            F.lit("abstain").alias("outcome"),
            F.lit(EXPIRED).alias("reasons"),
            F.lit("pending").alias("stability"),
            F.col("due").alias("due_at"),
            F.lit(False).alias("late"),
        ),
    )
    found = F.filter(F.array(own, timeout), lambda x: x.isNotNull())
    results = timed.select("case_id", "snapshot_id", F.inline(found)).select(*COLUMNS)
    if aside is None:
        return results
    refused = {"outcome": "abstain", "reasons": LATE, "stability": "unknown"}
    aside = aside.withColumns({"evaluated_at": F.col("available_at"), "due_at": F.lit(None).cast("timestamp"), **{k: F.lit(v) for k, v in refused.items()}})
    return results.unionByName(aside.select(*COLUMNS))


def final_states(results: DataFrame) -> DataFrame:
    """Per case: whether it was ever positive, is active or observed, or was retracted."""
    moves = F.col("outcome").isin("recommend", "observe_only", "retract")
    order = F.struct("evaluated_at", "snapshot_id")
    return results.groupBy("case_id").agg(
        F.bool_or(F.col("outcome").isin("recommend", "observe_only")).alias("positive"),
        F.bool_or(F.col("outcome") == "retract").alias("retracted"),
        F.coalesce(
            F.max_by(F.col("outcome") != "retract", F.when(moves, order)), F.lit(False)
        ).alias("active"),
        F.bool_or(F.col("reasons") == EXPIRED).alias("confirmation_miss"),
        F.count(F.lit(1)).alias("evaluations"),
    )


#: What the stream emits: `revision` counts corrections of the same evaluation, `mark` is set on late rows.
STREAMED = (
    "case_id string, snapshot_id string, evaluated long, outcome string, reasons string, stability string, "
    "due long, late boolean, event long, mark long, revision int"
)
_Told = Row(*(part.strip().split(" ")[0] for part in STREAMED.split(",")))
_INPUT = ("at", "event", "snapshot_id", "delivery", "retry", "superseding", "base", "why", "stability")
_RECENT = (
    "place long, arrived long, snapshot_id string, delivery string, retry boolean, superseding boolean, base string, why string, "
    "stability string, late boolean, beyond boolean, told string, revision int, fired boolean, fired_revision int"
)


class _Row:
    """A row that later arrivals may still be placed before, with what has been told about it."""

    names = tuple(part.strip().split(" ")[0] for part in _RECENT.split(","))
    __slots__ = names

    def __init__(self, *values) -> None:
        for name, value in zip(self.names, values):
            setattr(self, name, value)

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in self.names)


class _Detector(StatefulProcessor):
    """One case: its folded past, and the rows within the allowance, which are folded anew when a late one comes.

    case    the past before these rows: active, the pending snapshot with its due time and whether its
            expiry has been told; the newest event time; when `seen` is swept next
    recent  rows that a late one may still be placed before; none if nothing may be late
    seen    (delivery, when it was last seen), until `retry` later
    bound   the versions that the case was begun with, if the run has any

    Every access to state is a message to the JVM, so a call reads what it needs once and writes it once.
    """

    def __init__(self, confirm: int, allowed: int, retry: int, late_policy: str, versions: tuple[str, str, str] | None) -> None:
        self.confirm, self.allowed, self.retry, self.late_policy, self.versions = confirm, allowed, retry, late_policy, versions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        past = "active boolean, pending string, due long, fired boolean, fired_revision int, newest long, sweep long"
        self.case = handle.getValueState("case", past)
        self.recent = handle.getListState("recent", _RECENT)
        self.seen = handle.getListState("seen", "delivery string, at long")
        self.bound = handle.getValueState("bound", "detector string, policy string, source string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a case's rows of one micro-batch, whose size the source's trigger limits bound
        arrived = [tuple(row[name] for name in _INPUT) for row in rows]
        # a missing time is neither before nor after another
        arrived = [(*(float("nan") if t is None else t for t in r[:2]), *r[2:]) for r in arrived]
        arrived.sort(key=lambda r: (r[0], r[2]))
        held = self.case.get()
        past = [False, None, None, False, 0, None, None] if held is None else list(held)
        if self.versions and held is None:
            self.bound.update(self.versions)
        recent, seen = ([], {}) if held is None else (self._open(), dict(self.seen.get()))
        had_recent, had_seen = bool(recent), dict(seen)
        out: list[tuple] = []
        running = None
        for at, event, snapshot, delivery, retry, superseding, base, why, stability in arrived:
            newest = past[5]
            late = newest is not None and event < newest
            beyond = late and event < newest - self.allowed
            past[5] = event if newest is None else max(newest, event)
            mark = newest if late else None
            if beyond and self.late_policy == "abstain":
                out.append((key[0], snapshot, at, "abstain", LATE, "unknown", None, True, event, mark, 0))
                continue
            place = newest if beyond else event
            row = _Row(place, at, snapshot, delivery, retry, superseding, base, why, stability, late, beyond, None, -1, False, 0)
            k = len(recent)
            while k and (recent[k - 1].place, recent[k - 1].arrived, recent[k - 1].snapshot_id) > (place, at, snapshot):
                k -= 1
            recent.insert(k, row)
            running = self._fold(key[0], past, recent, seen, out, {id(row): (event, mark)})
            recent = self._settle(past, recent, seen)
        if running is not None:
            pending, due, owner = running
            # only the timer that runs at the end can come to an end between two calls
            if pending is not None and not (past[3] if owner is None else owner.fired):
                self.handle.registerTimer(self._timer(due))
        self.case.update(tuple(past))
        if recent:
            self.recent.put([r.values() for r in recent])
        elif had_recent:
            self.recent.clear()
        if seen != had_seen:
            self.seen.put(list(seen.items()))
        return iter([_Told(*told) for told in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.case.get()
        if held is None:
            return iter(())
        past = list(held)
        now = expiredTimerInfo.getExpiryTimeInMs()
        recent = self._open()
        swept = past[6] is not None and past[6] <= now
        seen = dict(self.seen.get()) if swept or any(row.retry for row in recent) else {}
        out: list[tuple] = []
        # an older timer of a pending state that was replaced or ended does nothing
        pending, due, owner = self._running(past, recent, seen)
        if pending is not None and self._timer(due) == now:
            told = past[3] if owner is None else owner.fired
            if not told:
                revision = past[4] if owner is None else owner.fired_revision
                out.append(self._expiry(key[0], pending, due, revision))
                if owner is None:
                    past[3], past[4] = True, revision + 1
                else:
                    owner.fired, owner.fired_revision = True, revision + 1
                    self.recent.put([r.values() for r in recent])
        if swept:
            past[6] = self._sweep(timerValues.getCurrentWatermarkInMs(), seen)
        if tuple(past) != tuple(held):
            self.case.update(tuple(past))
        return iter([_Told(*told) for told in out])

    def _open(self) -> list[_Row]:
        """The rows held as recent; there are none if nothing may be late."""
        return [_Row(*r) for r in self.recent.get()] if self.allowed else []

    def close(self) -> None:
        pass

    @staticmethod
    def _timer(due: int) -> int:
        return -(-due // 1000) + 1

    @staticmethod
    def _expiry(case: str, snapshot: str, due: int, revision: int, outcome: str = "abstain") -> tuple:
        return (case, snapshot, due, outcome, EXPIRED, "pending", due, False, None, None, revision)

    def _sweep(self, now: int, seen: dict[str, int]) -> int | None:
        """Forget deliveries that no retry can follow any more; when to look again."""
        until = {delivery: (at + self.retry) // 1000 + 1 for delivery, at in seen.items()}
        kept = [(delivery, at) for delivery, at in seen.items() if until[delivery] > now]
        if not kept:
            self.seen.clear()
            return None
        if len(kept) < len(seen):
            self.seen.put(kept)
        again = min(until[delivery] for delivery, _ in kept)
        self.handle.registerTimer(again)
        return again

    def _steps(self, past: list, recent: list[_Row], seen: dict[str, int]):
        """(row, outcome, why, stability, due, expired pending before it or None) in the order of place, from the past on.

        The expired one is (snapshot, due, its row or None if it lies in the past).
        """
        active, pending, due, owner = past[0], past[1], past[2], None
        copies: dict[str, int] = {}
        for row in recent:
            gone = None
            if pending is not None and row.place > due:
                gone, pending = (pending, due, owner), None
            before = copies.get(row.delivery)
            if before is None and row.retry:
                before = seen.get(row.delivery)
            copies[row.delivery] = row.place
            if row.retry and before is not None and row.place - before <= self.retry:
                yield row, "no_recommendation", REPEATED, "superseded", None, gone, (active, pending, due, owner)
                continue
            outcome = row.base
            if outcome == "resolved":
                outcome = "retract" if row.superseding and active else "no_recommendation"
            why = f"{row.why},{LATE}" if row.beyond else row.why
            own_due = None
            if outcome == "pending":
                pending, due, owner = row.snapshot_id, row.place + self.confirm, row
                own_due = due
            elif outcome in ("recommend", "observe_only", "retract"):
                active, pending = outcome != "retract", None
            yield row, outcome, why, row.stability, own_due, gone, (active, pending, due, owner)

    def _running(self, past: list, recent: list[_Row], seen: dict[str, int]):
        state = (past[0], past[1], past[2], None)
        for step in self._steps(past, recent, seen):
            state = step[6]
        return state[1:]

    def _fold(self, case: str, past: list, recent: list[_Row], seen: dict[str, int], out: list[tuple], fresh: dict):
        """Walk the recent rows and tell what is new or differs from what was told; the pending state that runs after them."""
        expired: set[int] = set()
        from_past = False
        for row, outcome, why, stability, due, gone, state in self._steps(past, recent, seen):
            if gone:
                snapshot, at, owner = gone
                if owner is None:
                    from_past = True
                    if not past[3]:
                        out.append(self._expiry(case, snapshot, at, past[4]))
                        past[3], past[4] = True, past[4] + 1
                else:
                    expired.add(id(owner))
                    if not owner.fired:
                        out.append(self._expiry(case, snapshot, at, owner.fired_revision))
                        owner.fired, owner.fired_revision = True, owner.fired_revision + 1
            told = f"{outcome}|{why}|{due}"
            if told != row.told:
                row.told, row.revision = told, row.revision + 1
                event, mark = fresh.get(id(row), (None, None))
                out.append((case, row.snapshot_id, row.arrived, outcome, why, stability, due, row.late, event, mark, row.revision))
        running, due, owner = state[1:]
        # an expiry that was told stays if its timer still runs: its time had come
        if past[3] and past[1] is not None and not from_past and not (running is not None and owner is None):
            out.append(self._expiry(case, past[1], past[2], past[4], WITHDRAWN))
            past[3], past[4] = False, past[4] + 1
        for row in recent:
            if row.fired and id(row) not in expired and not (running is not None and owner is row):
                out.append(self._expiry(case, row.snapshot_id, row.place + self.confirm, row.fired_revision, WITHDRAWN))
                row.fired, row.fired_revision = False, row.fired_revision + 1
        return running, due, owner

    def _settle(self, past: list, recent: list[_Row], seen: dict[str, int]) -> list[_Row]:
        """Fold the rows that no allowed late row can be placed before into the past; the others stay."""
        horizon = past[5] - self.allowed
        n = 0
        while n < len(recent) and recent[n].place <= horizon:
            n += 1
        if not n:
            return recent
        for step in self._steps(past, recent[:n], seen):
            state = step[6]
        for row in recent[:n]:
            seen[row.delivery] = row.place
            if past[6] is None:
                past[6] = (row.place + self.retry) // 1000 + 1
                self.handle.registerTimer(past[6])
        active, pending, due, owner = state
        past[0] = active
        if owner is not None or pending is None:
            past[1], past[2] = (pending, due) if pending is not None else (None, None)
            past[3], past[4] = (owner.fired, owner.fired_revision) if pending is not None else (False, 0)
        return recent[n:]


def detect_stream(
    snapshots: DataFrame,
    forms: DataFrame,
    spec: DetectorSpec,
    watermark: str = "0 seconds",
    versions: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Streaming form of `detect`; needs the RocksDB state store provider.

    The clock is the arrival (`available_at`), so no row is lost for its event time.  Where a late row
    changes what was said about a row after it, that evaluation is sent again with a higher
    `revision`; `settled` has the last word on each.  `late_arrivals` are the late rows themselves.
    Memory of deliveries goes `spec.retry_days` after they were last seen, by event-time timers.
    versions (detector, policy, source) are kept with every case, for `resume`.
    """
    # the processor travels by value, so workers need not have this package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = (
        decide(snapshots, forms, spec)
        .withWatermark("available_at", watermark)
        .withColumns({"at": F.unix_micros("available_at"), "event": F.unix_micros("event_at")})
    )
    minute = 60_000_000
    got = rows.groupBy("case_id").transformWithState(
        statefulProcessor=_Detector(
            spec.confirm_minutes * minute, spec.allowed_lateness_minutes * minute, spec.retry_days * 1440 * minute, spec.late_policy, versions
        ),
        outputStructType=STREAMED,
        outputMode="Append",
        timeMode="EventTime",
    )
    return got.select(
        "case_id",
        "snapshot_id",
        F.timestamp_micros("evaluated").alias("evaluated_at"),
        "outcome",
        "reasons",
        "stability",
        F.timestamp_micros("due").alias("due_at"),
        "late",
        F.timestamp_micros("event").alias("event_at"),
        F.timestamp_micros("mark").alias("mark"),
        "revision",
    )


def settled(emitted: DataFrame) -> DataFrame:
    """The last word on every evaluation of a stream's output; equals `detect` over the same rows."""
    key = ["case_id", "snapshot_id", "evaluated_at", F.col("reasons").eqNullSafe(EXPIRED).alias("timeout")]
    rest = F.struct(*[c for c in COLUMNS if c not in ("case_id", "snapshot_id", "evaluated_at")])
    got = emitted.groupBy(*key).agg(F.max_by(rest, "revision").alias("_r"))
    return got.select("case_id", "snapshot_id", "evaluated_at", "_r.*").where(F.col("outcome") != WITHDRAWN).select(*COLUMNS)


def late_arrivals(emitted: DataFrame, spec: DetectorSpec) -> DataFrame:
    """The second output: every late row with what it was behind of, by how much, and what was done with it."""
    behind = F.unix_micros("mark") - F.unix_micros("event_at")
    beyond = behind > spec.allowed_lateness_minutes * 60_000_000
    done = F.when(~beyond, "placed_by_event_time").otherwise("abstained" if spec.late_policy == "abstain" else "applied_with_warning")
    first = emitted.where((F.col("revision") == 0) & F.col("mark").isNotNull())
    return first.select("case_id", "snapshot_id", F.col("evaluated_at").alias("arrived_at"), "event_at", "mark", (behind / 60_000_000).alias("behind_minutes"), done.alias("done"))
