"""Bottleneck candidates and their reconciliation with baseline findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import hours_between
from ..functions.ids import stable_id
from ..functions.stats import first_ids, summarise
from ..session import Scale
from ..spec import MiningSpec
from .mining import edges

# fixed values: candidate type, subject activity, cohort dimension
FEATURE_RULES = (
    ("referral_source_rework_path", "Missing information requested", "referral_source"),
    ("service_line_scheduling_retries", "Scheduling failed", "service_line"),
    ("service_line_reassignment", "Clinical team reassigned", "service_line"),
)
ASSIGNMENT_FROM = ("Referral categorised", "Referral recategorised")
ASSIGNMENT_TO = "Clinical team assigned"
# fixed values: candidate types that can support each finding type
SUPPORTING_TYPES = {
    "lower_first_pass_completeness": ("referral_source_rework_path",),
    "elevated_rework": ("referral_source_rework_path", "service_line_scheduling_retries"),
    "longer_assignment_wait": ("service_line_assignment_delay",),
    "longer_booking_time": ("service_line_assignment_delay", "service_line_scheduling_retries"),
    "elevated_failed_scheduling": ("service_line_scheduling_retries",),
    "elevated_reassignment": ("service_line_reassignment",),
    "elevated_handoffs": ("service_line_reassignment",),
}
COLUMNS = (
    "candidate_id",
    "candidate_type",
    "subject",
    "dimension",
    "value",
    "cases",
    "frequency",
    "comparison",
    "observed",
    "absolute_difference",
    "relative_difference",
    "median_hours",
    "manual_rate",
    "handoff_rate",
    "materiality",
)


def materiality(relative: Column) -> Column:
    return F.when(relative >= 0.5, "strong").when(relative >= 0.2, "material").otherwise("small")


def _finish(df: DataFrame) -> DataFrame:
    diff = F.col("observed") - F.col("comparison")
    relative = F.when(F.col("comparison") != 0, diff / F.col("comparison"))
    have = set(df.columns)
    null = {"manual_rate", "handoff_rate", "dimension", "value", "comparison", "observed"} - have
    types = {c: "string" if c in ("dimension", "value") else "double" for c in null}
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})
    return df.withColumns(
        {
            "absolute_difference": diff,
            "relative_difference": relative,
            "materiality": materiality(relative),
            "candidate_id": stable_id(
                "candidate-", 16, F.col("candidate_type"), F.col("subject"), F.col("value")
            ),
        }
    ).select(*COLUMNS)


def trace_features(log: DataFrame) -> DataFrame:
    """Per case: cohort values, elapsed hours, and how often each rule activity occurs."""
    counts = [
        F.count_if(F.col("activity") == subject).alias(kind) for kind, subject, _ in FEATURE_RULES
    ]
    return log.groupBy("case_id", "referral_source", "service_line").agg(
        hours_between(F.min("event_at"), F.max("event_at")).alias("elapsed"), *counts
    )


def cohort_candidates(
    log: DataFrame, spec: MiningSpec, scale: Scale, least: float = 0.2
) -> DataFrame:
    """Cohorts where a rule activity is more common than overall by at least `least`."""
    entries = [
        F.struct(
            F.lit(kind).alias("candidate_type"),
            F.lit(subject).alias("subject"),
            F.lit(dim).alias("dimension"),
            F.col(dim).alias("value"),
            F.when(F.lit(kind == "referral_source_rework_path") & (F.col(kind) > 0), 1)
            .otherwise(F.col(kind))
            .cast("long")
            .alias("hits"),
        )
        for kind, subject, dim in FEATURE_RULES
    ]
    rows = trace_features(log).select("case_id", "elapsed", F.inline(F.array(*entries)))
    used = F.avg((F.col("hits") > 0).cast("int"))
    overall = rows.groupBy("candidate_type").agg(used.alias("comparison"))
    got = summarise(
        rows,
        ["candidate_type", "subject", "dimension", "value"],
        "elapsed",
        (0.5,),
        scale,
        extra=[
            F.count(F.lit(1)).alias("cases"),
            F.sum("hits").alias("frequency"),
            used.alias("observed"),
        ],
    ).join(F.broadcast(overall), "candidate_type")
    delta = (F.col("observed") - F.col("comparison")) / F.col("comparison")
    return _finish(
        got.where(
            (F.col("cases") >= spec.min_cohort) & (F.col("comparison") > 0) & (delta >= least)
        ).withColumn("median_hours", F.col("median"))
    )


def assignment_candidates(log: DataFrame, spec: MiningSpec, scale: Scale) -> DataFrame:
    """Service lines whose median categorised → assigned delay is 20 % above the overall median."""
    sizes = (
        log.where(F.col("pos") == 0).groupBy("service_line").agg(F.count(F.lit(1)).alias("cases"))
    )
    delays = edges(log).where(
        F.col("source").isin(*ASSIGNMENT_FROM) & (F.col("target") == ASSIGNMENT_TO)
    )
    overall = summarise(delays, [], "hours", (0.5,), scale).select(F.col("median").alias("comparison"))
    got = (
        summarise(delays, ["service_line"], "hours", (0.5,), scale)
        .join(sizes, "service_line")
        .crossJoin(F.broadcast(overall))  # one row
    )
    delta = (F.col("median") - F.col("comparison")) / F.col("comparison")
    return _finish(
        got.where(
            (F.col("cases") >= spec.min_cohort) & (F.col("comparison") > 0) & (delta >= 0.2)
        ).select(
            F.lit("service_line_assignment_delay").alias("candidate_type"),
            F.lit("Referral categorised -> Clinical team assigned").alias("subject"),
            F.lit("service_line").alias("dimension"),
            F.col("service_line").alias("value"),
            "cases",
            F.col("n").alias("frequency"),
            "comparison",
            F.col("median").alias("observed"),
            F.col("median").alias("median_hours"),
        )
    )


def slow_transitions(stats: DataFrame, spec: MiningSpec, scale: Scale) -> DataFrame:
    """Frequent edges with a median of at least 1.5 × the median of frequent edges' medians."""
    frequent = stats.where(
        (F.col("frequency") >= spec.min_transition) & F.col("hours_median").isNotNull()
    )
    # one row per pair of activities: bounded by the vocabulary, whatever the log's size
    base = summarise(frequent, [], "hours_median", (0.5,), Scale(0)).select(
        F.col("median").alias("comparison")
    )
    got = frequent.crossJoin(F.broadcast(base))
    return _finish(
        got.where(F.col("hours_median") >= F.col("comparison") * 1.5).select(
            F.lit("high_frequency_slow_transition").alias("candidate_type"),
            F.concat_ws(" -> ", "source", "target").alias("subject"),
            "cases",
            "frequency",
            "comparison",
            F.col("hours_median").alias("observed"),
            F.col("hours_median").alias("median_hours"),
            "manual_rate",
            "handoff_rate",
        )
    )


def slow_variants(
    variants: DataFrame, spec: MiningSpec, scale: Scale, factor: float = 1.5
) -> DataFrame:
    """Variants of enough cases with a median duration of at least factor × the median of all."""
    base = summarise(variants, [], "duration_median", (0.5,), scale).select(
        F.col("median").alias("comparison")
    )
    got = variants.crossJoin(F.broadcast(base))
    keep = (F.col("cases") >= spec.min_variant) & (
        F.col("duration_median") >= F.col("comparison") * factor
    )
    return _finish(
        got.where(keep).select(
            F.lit("variant_elevated_duration").alias("candidate_type"),
            F.col("variant_id").alias("subject"),
            "cases",
            F.col("cases").alias("frequency"),
            "comparison",
            F.col("duration_median").alias("observed"),
            F.col("duration_median").alias("median_hours"),
        )
    )


def nonconforming_duration(
    log: DataFrame, results: DataFrame, spec: MiningSpec, scale: Scale
) -> DataFrame:
    """One candidate when enough traces do not fully conform (results: case conformance)."""
    bad = results.where(F.col("conformance") != "fully_conforming").select("case_id")
    elapsed = trace_features(log).join(bad, "case_id", "left_semi")
    got = summarise(elapsed, [], "elapsed", (0.5,), scale)
    return _finish(
        got.where(F.col("n") >= spec.min_cohort).select(
            F.lit("nonconforming_path_duration").alias("candidate_type"),
            F.lit("governed non-conforming traces").alias("subject"),
            F.col("n").alias("cases"),
            F.col("n").alias("frequency"),
            F.col("median").alias("median_hours"),
        )
    )


def candidate_support(log: DataFrame, candidates: DataFrame, k: int = 25) -> DataFrame:
    """First k case ids of each cohort candidate."""
    members = trace_features(log).select(
        "case_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
                    for d in ("referral_source", "service_line")
                ]
            )
        ),
    )
    hits = members.join(candidates.select("candidate_id", "dimension", "value"), ["dimension", "value"])
    return first_ids(hits, ["candidate_id"], "case_id", k, "supporting_case_ids")


def supporting_types(spark: SparkSession, pairs=SUPPORTING_TYPES) -> DataFrame:
    rows = [(finding, kind) for finding, kinds in pairs.items() for kind in kinds]
    return spark.createDataFrame(rows, "finding_type string, candidate_type string")


def reconcile(found: DataFrame, candidates: DataFrame, types: DataFrame) -> DataFrame:
    """Findings with the process candidates that support them."""
    linked = (
        found.select("finding_id", "finding_type", "dimension", "value")
        .join(F.broadcast(types), "finding_type", "left")
        .join(
            candidates.select("candidate_id", "candidate_type", "dimension", "value", "cases"),
            ["candidate_type", "dimension", "value"],
            "left",
        )
    )
    return linked.groupBy("finding_id").agg(
        F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"),
        (F.count("candidate_id") > 0).alias("supported"),
        F.coalesce(F.max("cases"), F.lit(0)).alias("sample_size"),
    )
