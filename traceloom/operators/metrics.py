"""The 17 per-case metrics: two window passes and one aggregation per case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MICROS_HOUR, business_micros, hours_between, worked_micros
from ..functions.ordered import scan
from ..session import Scale
from ..spec import BaselineSpec
from .timeline import ORDER, IDENTITY, filter_period, flag_aggregates, timeline

# fixed values: metric names and units
METRICS = {
    "case_duration_hours": "hours",
    "cycle_time_hours": "hours",
    "manual_touches": "events",
    "processing_time_estimate_hours": "hours",
    "handoffs": "transitions",
    "rework_count": "events",
    "failed_scheduling_attempts": "events",
    "reassignment_count": "events",
    "is_stuck": "boolean",
    "first_pass_complete": "boolean",
    "time_to_first_completeness_check_hours": "hours",
    "time_to_appointment_booking_hours": "hours",
    "waiting_time_business_hours": "business_hours",
    "assignment_wait_business_hours": "business_hours",
    "max_ingestion_delay_hours": "hours",
    "delayed_event_count": "events",
    "out_of_order_ingestion": "boolean",
}
BOOLEAN_METRICS = ("is_stuck", "first_pass_complete", "out_of_order_ingestion")
ATTRIBUTES = (
    "referral_source",
    "service_line",
    "source_system",
    "assigned_team",
    "terminal_outcome",
)


def precision_of(status: Column) -> Column:
    return (
        F.when(status == "calculated", "exact")
        .when(status.isin("estimated", "partial"), status)
        .otherwise("unavailable")
    )


def _is(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _annotate(rows: DataFrame, spec: BaselineSpec, scale: Scale) -> DataFrame:
    """Running counts, totals and carried values on each timeline row."""
    r = spec.roles
    internal = F.col("actor_type").isin(*r.internal_actors) & F.col("actor_id").isNotNull()
    first = scan(
        rows.withColumn("internal", internal),
        ["case_id"],
        ORDER,
        scale,
        running={
            "n_received": _flag(_is(r.received)),
            "n_check": _flag(_is(r.check)),
            "n_cat": _flag(_is(r.categorised)),
            "n_start": _flag(_is(r.start)),
            "n_assigned": _flag(_is(r.assigned)),
            "n_owner": _flag(_is(r.assigned, r.reassigned)),
            "n_req": _flag(_is(r.request)),
            "n_resp": _flag(_is(r.response)),
        },
        carry={
            "actor_seen": F.when(F.col("internal"), F.col("actor_id")),
            "last_sched": F.when(_is(r.start, r.failed), F.col("event_type")),
        },
        totals={
            "t_check": _flag(_is(r.check)),
            "t_start": _flag(_is(r.start)),
            "t_resp": _flag(_is(r.response)),
            "t_end": _flag(_is(*r.terminal)),
        },
    )
    surplus = F.col("n_resp") - F.col("n_req")
    return scan(
        first.withColumn("work_at", worked_micros(F.col("event_at"), spec.calendar)),
        ["case_id"],
        ORDER,
        scale,
        previous={"actor_before": F.col("actor_seen")},
        following={"next_work": F.col("work_at")},
        peak={"_surplus": surplus},
        highest={"_surplus_all": surplus},
        totals={"t_owner_first": _flag(_is(r.assigned, r.reassigned) & (F.col("n_start") == 0))},
    ).withColumns(
        {
            # a response without an open request before it is never used, and the
            # number of those so far is the running maximum of the surplus
            "n_used": F.col("n_resp") - F.greatest(F.lit(0), F.col("_surplus")),
            "t_used": F.col("t_resp") - F.greatest(F.lit(0), F.col("_surplus_all")),
        }
    )


def _waiting(spec: BaselineSpec) -> dict[str, Column]:
    """Waiting time as a sweep: is the case waiting between this event and the next?

    The union of the wait intervals needs no merging: each gap between
    neighbouring events counts once if any wait covers it.
    """
    r = spec.roles
    closed_wait = reduce(
        lambda a, b: a | b,
        [
            # receipt to first check
            (F.col("n_received") > 0) & (F.col("n_check") == 0) & (F.col("t_check") > 0),
            # answered requests: the first t_used requests are the matched ones
            F.least(F.col("n_req"), F.col("t_used")) > F.col("n_used"),
            # last assignment before the first scheduling start
            (F.col("t_owner_first") > 0)
            & (F.col("n_owner") == F.col("t_owner_first"))
            & (F.col("n_start") == 0)
            & (F.col("t_start") > 0),
            # failure to the next start
            (F.col("last_sched") == r.failed) & (F.col("n_start") < F.col("t_start")),
        ],
    )
    lost_request = F.col("n_req") > F.col("t_used")
    lost_retry = (F.col("last_sched") == r.failed) & (F.col("n_start") == F.col("t_start"))
    cutoff = F.lit(spec.cutoff).cast("timestamp")
    is_open = (F.col("t_end") == 0) & F.lit(spec.include_open)
    at, until = F.col("event_at"), worked_micros(cutoff, spec.calendar)
    closed_wait = F.coalesce(closed_wait, F.lit(False))
    open_wait = is_open & F.coalesce(lost_request | lost_retry, F.lit(False)) & (at < cutoff)
    # cumulative working time is monotone, so clipping at the cutoff can be done on it
    ends = F.when(closed_wait, F.col("next_work")).when(
        open_wait, F.least(F.coalesce("next_work", until), until)
    )
    gap = F.coalesce(ends - F.col("work_at"), F.lit(0))
    unanswered = (_is(r.request) & lost_request) | (_is(r.failed) & lost_retry)
    unanswered = F.coalesce(unanswered, F.lit(False))
    extended = unanswered & is_open & (at <= cutoff)
    return {
        "wait_micros": F.sum(gap),
        "wait_partial": F.bool_or(extended),
        "wait_unmatched": F.count_if(unanswered & ~extended),
    }


def case_aggregates(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, scale: Scale
) -> DataFrame:
    """One row per case that has events: every ingredient of the metrics and flags."""
    r = spec.roles
    narrowed = bool(spec.period_start or spec.period_end)
    rows = _annotate(timeline(events, cases, spec, scale, known_only=narrowed), spec, scale)

    # positions follow time, so the first event of a kind is the one with the smallest time
    def first(cond: Column) -> Column:
        return F.min(F.when(cond, F.col("event_at")))

    def last(cond: Column) -> Column:
        return F.max(F.when(cond, F.col("event_at")))

    delay = hours_between(F.col("event_at"), F.col("ingested_at"))
    aggs = {
        "received": first(_is(r.received)),
        "terminal": first(_is(*r.terminal)),
        "terminals": F.count_if(_is(*r.terminal)),
        "first_check": first(_is(r.check)),
        "first_cat": first(_is(r.categorised)),
        "first_assigned": first(_is(r.assigned)),
        "first_booked": first(_is(r.booked)),
        "last_progress": last(_is(*r.progress)),
        "cat_before_assigned": last(
            _is(r.categorised, r.recategorised) & (F.col("n_assigned") == 0)
        ),
        "cats": F.count_if(_is(r.categorised, r.recategorised)),
        "checks": F.count_if(_is(r.check)),
        "requests": F.count_if(_is(r.request)),
        "recats": F.count_if(_is(r.recategorised)),
        "reassigned": F.count_if(_is(r.reassigned)),
        "failed": F.count_if(_is(r.failed)),
        "late_requests": F.count_if(
            _is(r.request) & (F.col("n_check") > 0) & (F.col("n_cat") == 0)
        ),
        "manual": F.count_if(F.col("manual")),
        "handoffs": F.count_if(
            F.col("internal") & (F.col("actor_before") != F.col("actor_id"))
        ),
        "max_delay": F.max(delay),
        "delayed": F.count_if(delay > spec.delayed_hours),
        **_waiting(spec),
    }
    return rows.groupBy("case_id").agg(
        *[e.alias(n) for n, e in aggs.items()], *flag_aggregates(spec)
    )


def _duplicates(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(*IDENTITY)
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .groupBy("case_id")
        .agg(F.sum("_extra").alias("duplicates"))
    )


def case_metrics(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, scale: Scale
) -> DataFrame:
    """One wide row per analysed case: attributes, value and status of each metric.

    Cases of an unsupported schema version, and duplicated cases under the
    reject policy, are left out; cases without events stay.
    """
    base = filter_period(cases, spec).where(F.col("schema_version") == spec.schema_version)
    joined = base.join(case_aggregates(events, cases, spec, scale), "case_id", "left").where(
        ~F.coalesce("unsupported_events", F.lit(False))
    )
    if spec.reject_duplicates:
        dup = _duplicates(events).where(F.col("duplicates") > 0)
        joined = joined.join(dup, "case_id", "left_anti")

    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    cutoff = F.lit(spec.cutoff).cast("timestamp")
    got, end = F.col("received"), F.col("terminal")
    got_at, end_at = got, end
    none, hours = F.lit(None).cast("double"), hours_between
    reversed_ = end.isNotNull() & (end_at < got_at)
    open_ok = F.lit(spec.include_open) & (cutoff >= got_at)
    inferred = F.greatest(F.lit(0), n("checks") - 1) + F.greatest(F.lit(0), n("requests") - 1)
    progress_at = F.col("last_progress")
    check, booked = F.col("first_check"), F.col("first_booked")
    cat_at = F.col("cat_before_assigned")
    both = (n("cats") > 0) & F.col("first_assigned").isNotNull()
    ended_status = F.col("status").isin("completed", "cancelled", "rejected", "closed_other")

    def since_receipt(event: str) -> tuple[Column, Column]:
        at, ok = F.col(event), got.isNotNull() & F.col(event).isNotNull()
        value = F.when(ok & (at >= got_at), hours(got_at, at))
        return value, ok & (at < got_at)

    to_check, check_bad = since_receipt("first_check")
    to_book, book_bad = since_receipt("first_booked")
    pass_known = check.isNotNull() & (F.col("first_cat").isNotNull() | (n("late_requests") > 0))

    values: dict[str, tuple[Column, Column]] = {
        "case_duration_hours": (
            F.when(got.isNull() | reversed_, none)
            .when(end.isNotNull(), hours(got_at, end_at))
            .when(open_ok, hours(got_at, cutoff)),
            F.when(got.isNull(), "unavailable")
            .when(reversed_, "invalid_input")
            .when(end.isNotNull(), "calculated")
            .when(open_ok, "partial")
            .otherwise("excluded"),
        ),
        "cycle_time_hours": (
            F.when(got.isNotNull() & end.isNotNull() & ~reversed_, hours(got_at, end_at)),
            F.when(got.isNull(), "unavailable")
            .when(reversed_, "invalid_input")
            .when(end.isNotNull(), "calculated")
            .otherwise("not_applicable"),
        ),
        "manual_touches": (n("manual"), F.lit("calculated")),
        "processing_time_estimate_hours": (
            n("manual") * F.lit(spec.touch_minutes) / 60,
            F.lit("estimated"),
        ),
        "handoffs": (n("handoffs"), F.lit("estimated")),
        "rework_count": (
            inferred + n("recats") + n("reassigned") + n("failed"),
            F.when(inferred > 0, "estimated").otherwise("calculated"),
        ),
        "failed_scheduling_attempts": (n("failed"), F.lit("calculated")),
        "reassignment_count": (n("reassigned"), F.lit("calculated")),
        "is_stuck": (
            F.when(end.isNotNull(), F.lit(False)).when(
                cutoff >= progress_at, hours(progress_at, cutoff) >= spec.stuck_hours
            ),
            F.when(end.isNotNull() | (cutoff >= progress_at), "calculated").otherwise(
                "unavailable"
            ),
        ),
        "first_pass_complete": (
            F.when(pass_known, n("late_requests") == 0),
            F.when(pass_known, "estimated").otherwise("unavailable"),
        ),
        "time_to_first_completeness_check_hours": (
            to_check,
            F.when(check_bad, "invalid_input")
            .when(to_check.isNotNull(), "calculated")
            .otherwise("unavailable"),
        ),
        "time_to_appointment_booking_hours": (
            to_book,
            F.when(book_bad, "invalid_input")
            .when(to_book.isNotNull(), "calculated")
            .when(ended_status, "not_applicable")
            .otherwise("unavailable"),
        ),
        "waiting_time_business_hours": (
            n("wait_micros") / F.lit(float(MICROS_HOUR)),
            F.when(F.col("wait_partial"), "partial").otherwise("estimated"),
        ),
        "assignment_wait_business_hours": (
            F.when(
                both & cat_at.isNotNull(),
                business_micros(cat_at, F.col("first_assigned"), spec.calendar)
                / F.lit(float(MICROS_HOUR)),
            ),
            F.when(~both, "unavailable")
            .when(cat_at.isNotNull(), "estimated")
            .otherwise("invalid_input"),
        ),
        "max_ingestion_delay_hours": (F.coalesce("max_delay", F.lit(0.0)), F.lit("calculated")),
        "delayed_event_count": (n("delayed"), F.lit("calculated")),
        "out_of_order_ingestion": (
            F.coalesce("out_of_order", F.lit(False)),
            F.lit("calculated"),
        ),
    }
    columns = [
        F.col("case_id"),
        F.col("status").alias("terminal_outcome"),
        "referral_source",
        "service_line",
        F.col("primary_source_system").alias("source_system"),
        "assigned_team",
        F.col("received_at"),
        F.col("closed_at"),
        n("events").alias("events"),
        n("wait_unmatched").alias("unmatched_waits"),
        n("terminals").alias("terminals"),
        n("checks").alias("checks"),
        got.isNotNull().alias("has_received"),
        F.coalesce("identical_timestamps", F.lit(False)).alias("identical_timestamps"),
    ]
    for name, (value, status) in values.items():
        columns += [value.alias(name), status.alias(f"{name}_status")]
    return joined.select(*columns)


def metrics_long(wide: DataFrame) -> DataFrame:
    """(case, metric, number, flag, status, precision) rows from the wide form."""
    entries = []
    for name, unit in METRICS.items():
        flag = name in BOOLEAN_METRICS
        status = F.col(f"{name}_status")
        entries.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.lit(unit).alias("unit"),
                (F.lit(None).cast("double") if flag else F.col(name).cast("double")).alias("number"),
                (F.col(name) if flag else F.lit(None).cast("boolean")).alias("flag"),
                status.alias("status"),
                precision_of(status).alias("precision"),
            )
        )
    keep = ["case_id", *ATTRIBUTES]
    return wide.select(*keep, F.inline(F.array(*entries)))


def metric_provenance(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, scale: Scale
) -> DataFrame:
    """(case, metric, role, event id): which events each metric was taken from.

    Flat rows and no arrays, so a case with very many manual events stays splittable.
    """
    r = spec.roles
    rows = _annotate(timeline(events, cases, spec, scale), spec, scale)
    rows = scan(
        rows,
        ["case_id"],
        ORDER,
        scale,
        running={
            "n_end": _flag(_is(*r.terminal)),
            "n_booked": _flag(_is(r.booked)),
        },
        totals={
            "t_received": _flag(_is(r.received)),
            "t_booked": _flag(_is(r.booked)),
        },
    )
    received = _is(r.received) & (F.col("n_received") == 1)
    ended = _is(*r.terminal) & (F.col("n_end") == 1)
    check = _is(r.check) & (F.col("n_check") == 1)
    booked = _is(r.booked) & (F.col("n_booked") == 1)
    tests = [
        ("case_duration_hours", "start", received),
        ("case_duration_hours", "end", ended & (F.col("t_received") > 0)),
        ("manual_touches", "source", F.col("manual")),
        ("rework_count", "source", _is(r.recategorised, r.reassigned, r.failed)),
        ("failed_scheduling_attempts", "source", _is(r.failed)),
        ("reassignment_count", "source", _is(r.reassigned)),
        ("time_to_first_completeness_check_hours", "start", received & (F.col("t_check") > 0)),
        ("time_to_first_completeness_check_hours", "end", check & (F.col("t_received") > 0)),
        ("time_to_appointment_booking_hours", "start", received & (F.col("t_booked") > 0)),
        ("time_to_appointment_booking_hours", "end", booked & (F.col("t_received") > 0)),
        (
            "delayed_event_count",
            "source",
            hours_between(F.col("event_at"), F.col("ingested_at")) > spec.delayed_hours,
        ),
    ]
    found = F.array(
        *[
            F.when(test, F.struct(F.lit(metric).alias("metric"), F.lit(role).alias("role")))
            for metric, role, test in tests
        ]
    )
    return rows.select(
        "case_id", "event_id", F.inline(F.filter(found, lambda x: x.isNotNull()))
    ).select("case_id", "metric", "role", "event_id")
