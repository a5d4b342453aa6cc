"""Canonical case timelines: one ordered, deduplicated row per event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import scan
from ..session import Scale
from ..spec import BaselineSpec

ORDER = ["event_at", "event_id"]
IDENTITY = ["case_id", "source_system", "external_event_id"]


def in_period(spec: BaselineSpec) -> Column:
    """Half-open filter on the receipt time."""
    keep = F.lit(True)
    if spec.period_start:
        keep = keep & (F.col("received_at") >= F.lit(spec.period_start))
    if spec.period_end:
        keep = keep & (F.col("received_at") < F.lit(spec.period_end))
    return keep


def filter_period(cases: DataFrame, spec: BaselineSpec) -> DataFrame:
    return cases.where(in_period(spec))


def period_counts(cases: DataFrame, spec: BaselineSpec) -> DataFrame:
    keep = in_period(spec)
    return cases.agg(
        F.count_if(keep).alias("included_cases"), F.count_if(~keep).alias("excluded_cases")
    )


def join_case_events(events: DataFrame, cases: DataFrame, *columns: str) -> DataFrame:
    """Inner join that brings the named case attributes to each event."""
    attrs = cases.select("case_id", *[F.col(c).alias(f"case_{c}") for c in columns])
    return events.join(attrs, "case_id")


def orphan_events(events: DataFrame, cases: DataFrame) -> DataFrame:
    return events.join(cases.select("case_id"), "case_id", "left_anti")


def empty_cases(events: DataFrame, cases: DataFrame) -> DataFrame:
    return cases.join(events.select("case_id"), "case_id", "left_anti")


def with_copies(events: DataFrame, scale: Scale) -> DataFrame:
    """Number the copies of each source identity inside its case; 0 is the one kept."""
    return scan(events, IDENTITY, ORDER, scale, position="copy_no", cluster=["case_id"])


def deduplicate(events: DataFrame, scale: Scale) -> DataFrame:
    return with_copies(events, scale).where(F.col("copy_no") == 0).drop("copy_no")


def timeline(
    events: DataFrame,
    cases: DataFrame,
    spec: BaselineSpec,
    scale: Scale,
    *,
    known_only: bool = True,
) -> DataFrame:
    """Events of known cases in the period, first copy only, with position and neighbours.

    The events are distributed by case once; every later window and per-case
    aggregate keeps that distribution.  With ``known_only=False`` orphans stay,
    for callers that join the result to the cases anyway.
    """
    if known_only:
        known = filter_period(cases, spec).select("case_id")
        events = events.join(known, "case_id", "left_semi")
    kept = deduplicate(events, scale)
    return scan(
        kept,
        ["case_id"],
        ORDER,
        scale,
        position="pos",
        previous={"prev_at": F.col("event_at"), "prev_ingested": F.col("ingested_at")},
        following={"next_at": F.col("event_at")},
    )


def last_attribute(rows: DataFrame, value: str, types: tuple[str, ...], name: str) -> DataFrame:
    """Latest non-null value per case among the given event types."""
    wanted = F.col("event_type").isin(*types) & F.col(value).isNotNull()
    return rows.groupBy("case_id").agg(
        F.max(F.when(wanted, F.struct(*ORDER, value)))[value].alias(name)
    )


def first_attribute(rows: DataFrame, value: str, types: tuple[str, ...], name: str) -> DataFrame:
    wanted = F.col("event_type").isin(*types)
    return rows.groupBy("case_id").agg(
        F.min(F.when(wanted, F.struct(*ORDER, value)))[value].alias(name)
    )


def flag_aggregates(spec: BaselineSpec) -> list[Column]:
    """Per-case quality flags over timeline rows (usable in any groupBy case)."""
    roles = spec.roles
    team = F.col("event_type").isin(roles.assigned, roles.reassigned) & F.col("team_id").isNotNull()
    received = F.col("event_type") == roles.received
    return [
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.bool_or(F.col("prev_at") == F.col("event_at")), F.lit(False)).alias(
            "identical_timestamps"
        ),
        F.coalesce(F.bool_or(F.col("ingested_at") < F.col("prev_ingested")), F.lit(False)).alias(
            "out_of_order"
        ),
        F.bool_or(F.col("schema_version") != spec.schema_version).alias("unsupported_events"),
        F.min(F.when(received, F.struct(*ORDER, "source_system")))["source_system"].alias(
            "primary_source_system"
        ),
        F.max(F.when(team, F.struct(*ORDER, "team_id")))["team_id"].alias("assigned_team"),
    ]


def case_flags(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, scale: Scale, mapped: Sequence[str] | None = None
) -> DataFrame:
    """One row per case of the period, also for cases without events.

    mapped: event types that have an activity; other events count as `unmapped` (none if not given).
    """
    rows = timeline(events, cases, spec, scale, known_only=bool(spec.period_start or spec.period_end))
    unmapped = F.lit(False) if mapped is None else ~F.coalesce(F.col("event_type").isin(*mapped), F.lit(False))
    flags = rows.groupBy("case_id").agg(*flag_aggregates(spec), F.count_if(unmapped).alias("unmapped"))
    copies = (
        events.groupBy(*IDENTITY)
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .groupBy("case_id")
        .agg(F.sum("_extra").alias("duplicates"))
    )
    return (
        filter_period(cases, spec)
        .select("case_id", F.col("schema_version").alias("_cv"))
        .join(flags, "case_id", "left")
        .join(copies, "case_id", "left")
        .select(
            "case_id",
            F.coalesce("events", F.lit(0)).alias("events"),
            F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
            F.coalesce("unmapped", F.lit(0)).alias("unmapped"),
            F.coalesce("identical_timestamps", F.lit(False)).alias("identical_timestamps"),
            F.coalesce("out_of_order", F.lit(False)).alias("out_of_order"),
            (
                (F.col("_cv") == spec.schema_version)
                & ~F.coalesce("unsupported_events", F.lit(False))
            ).alias("supported"),
            "primary_source_system",
            "assigned_team",
        )
    )


def filter_supported(flags: DataFrame, spec: BaselineSpec) -> DataFrame:
    """Cases that enter the analysis: supported, and unduplicated under the reject policy."""
    keep = F.col("supported")
    if spec.reject_duplicates:
        keep = keep & (F.col("duplicates") == 0)
    return flags.where(keep)
