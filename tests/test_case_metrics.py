from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom.functions.calendar import business_hours, business_hours_by_day
from traceloom.operators.metrics import case_metrics
from traceloom.operators.timeline import case_flags
from traceloom.session import Scale
from traceloom.spec import BaselineSpec, Calendar

from .ten_cases import frames

SPEC = BaselineSpec(cutoff=datetime(2026, 1, 31), delayed_hours=4)


@pytest.fixture(scope="module", params=[1_000_000, 3], ids=["plain", "split"])
def metrics(spark, request):
    events, cases = frames(spark)
    got = case_metrics(events, cases, SPEC, Scale(1000, request.param)).collect()
    return {r.case_id: r.asDict() for r in got}


EXPECTED = [
    ("c0", "case_duration_hours", 8.0, "calculated"),
    ("c0", "first_pass_complete", True, "estimated"),
    ("c0", "rework_count", 0, "calculated"),
    ("c0", "manual_touches", 6, "calculated"),
    ("c0", "handoffs", 2, "estimated"),
    ("c0", "time_to_appointment_booking_hours", 7.0, "calculated"),
    ("c1", "first_pass_complete", False, "estimated"),
    ("c1", "case_duration_hours", 33.0, "calculated"),
    ("c1", "waiting_time_business_hours", 12.5, "estimated"),
    ("c1", "manual_touches", 8, "calculated"),
    ("c1", "rework_count", 1, "estimated"),
    ("c2", "case_duration_hours", 60.0, "calculated"),
    ("c2", "waiting_time_business_hours", 23.0, "estimated"),
    ("c2", "manual_touches", 10, "calculated"),
    ("c2", "rework_count", 3, "estimated"),
    ("c3", "rework_count", 2, "calculated"),
    ("c3", "reassignment_count", 1, "calculated"),
    ("c3", "handoffs", 4, "estimated"),
    ("c4", "failed_scheduling_attempts", 2, "calculated"),
    ("c4", "rework_count", 2, "calculated"),
    ("c4", "time_to_appointment_booking_hours", 59.0, "calculated"),
    ("c5", "time_to_appointment_booking_hours", None, "not_applicable"),
    ("c6", "time_to_appointment_booking_hours", None, "not_applicable"),
    ("c7", "cycle_time_hours", None, "not_applicable"),
    ("c7", "is_stuck", True, "calculated"),
    ("c8", "case_duration_hours", 8.0, "calculated"),
    ("c9", "case_duration_hours", 16.0, "calculated"),
    ("c9", "time_to_first_completeness_check_hours", 2.0, "calculated"),
    ("c9", "max_ingestion_delay_hours", 8.0, "calculated"),
    ("c9", "delayed_event_count", 1, "calculated"),
    ("c9", "out_of_order_ingestion", True, "calculated"),
]


@pytest.mark.parametrize("case,metric,value,status", EXPECTED)
def test_expected(metrics, case, metric, value, status):
    got = metrics[case][metric]
    assert metrics[case][f"{metric}_status"] == status
    assert got == pytest.approx(value, abs=1e-6) if isinstance(value, float) else got == value


def test_open_case_is_partial(metrics):
    assert metrics["c7"]["case_duration_hours_status"] == "partial"
    assert metrics["c7"]["waiting_time_business_hours_status"] == "partial"
    assert metrics["c5"]["case_duration_hours_status"] == "calculated"


def test_duplicate_removed(spark):
    events, cases = frames(spark)
    flags = {r.case_id: r for r in case_flags(events, cases, SPEC, Scale(1000)).collect()}
    assert flags["c8"].duplicates == 1
    assert flags["c8"].events == 9
    assert events.where("case_id = 'c8'").count() == 10
    assert flags["c9"].out_of_order and not flags["c0"].out_of_order


def test_reject_policy(spark):
    events, cases = frames(spark)
    spec = BaselineSpec(cutoff=datetime(2026, 1, 31), reject_duplicates=True)
    got = {r.case_id for r in case_metrics(events, cases, spec, Scale(1000)).collect()}
    assert got == {f"c{i}" for i in range(10)} - {"c8"}


def test_period_and_empty_cases(spark):
    events, cases = frames(spark)
    spec = BaselineSpec(
        cutoff=datetime(2026, 1, 31),
        period_start=datetime(2026, 1, 6, 9),
        period_end=datetime(2026, 1, 9, 9),
    )
    got = case_metrics(events.where("case_id <> 'c2'"), cases, spec, Scale(1000)).collect()
    assert {r.case_id for r in got} == {"c1", "c2", "c3"}
    empty = next(r for r in got if r.case_id == "c2")
    assert empty.case_duration_hours_status == "unavailable" and empty.manual_touches == 0


def test_business_hours(spark):
    cal = Calendar()
    spans = [(datetime(2026, 1, 9, 16), datetime(2026, 1, 12, 10), 4.0)]
    at = datetime(2026, 3, 20, 3, 17)
    for i in range(60):  # across the clock change
        spans.append((at + timedelta(hours=7 * i), at + timedelta(hours=7 * i + 11 * i), None))
    df = spark.createDataFrame(spans, "a timestamp, b timestamp, want double")
    got = df.select(
        "want",
        business_hours(F.col("a"), F.col("b"), cal).alias("fast"),
        business_hours_by_day(F.col("a"), F.col("b"), cal).alias("slow"),
    ).collect()
    assert got[0].fast == 4.0
    assert all(abs(r.fast - r.slow) < 1e-9 for r in got)
