"""Cohort roll-ups, rates, summaries and material findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.stats import first_ids, label, summarise
from ..session import Scale
from ..spec import BaselineSpec
from .metrics import BOOLEAN_METRICS, METRICS

SUMMARY_METRICS = (
    "case_duration_hours",
    "waiting_time_business_hours",
    "processing_time_estimate_hours",
    "manual_touches",
    "handoffs",
    "rework_count",
    "time_to_first_completeness_check_hours",
    "time_to_appointment_booking_hours",
    "assignment_wait_business_hours",
    "failed_scheduling_attempts",
    "reassignment_count",
    "max_ingestion_delay_hours",
)
RATES = (
    "completion_rate",
    "cancellation_rate",
    "rejection_rate",
    "stuck_case_rate",
    "first_pass_completeness_rate",
    "delayed_ingestion_rate",
    "out_of_order_ingestion_rate",
    "metric_availability_rate",
)
# fixed values: finding type, metric, direction, dimensions
FINDING_RULES = (
    ("lower_first_pass_completeness", "first_pass_completeness_rate", "lower", ("referral_source",)),
    ("longer_assignment_wait", "assignment_wait_business_hours", "higher", ("service_line",)),
    ("longer_booking_time", "time_to_appointment_booking_hours", "higher", ("service_line",)),
    ("elevated_failed_scheduling", "failed_scheduling_attempts", "higher", ("service_line",)),
    ("elevated_rework", "rework_count", "higher", ("referral_source", "service_line")),
    ("elevated_reassignment", "reassignment_count", "higher", ("service_line",)),
    ("elevated_handoffs", "handoffs", "higher", ("service_line",)),
    ("longer_case_duration", "case_duration_hours", "higher", ("referral_source", "service_line")),
    ("elevated_stuck_rate", "stuck_case_rate", "higher", ("referral_source", "service_line")),
    ("elevated_delayed_ingestion", "delayed_ingestion_rate", "higher", ("source_system",)),
)


def members(wide: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Each case once under ('overall', 'all') and once per dimension it has a value for."""
    pairs = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    pairs += [
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for d in dimensions
    ]
    listed = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
    return wide.select("*", F.inline(listed))


def _rate_parts() -> dict[str, tuple[Column, Column]]:
    ended = F.col("terminal_outcome").isin(*vocab.TERMINAL_STATUSES)
    terminal, cases = F.count_if(ended), F.count(F.lit(1))
    usable = sum(
        (
            F.when(F.col(f"{m}_status").isin("calculated", "estimated", "partial"), 1).otherwise(0)
            for m in METRICS
        ),
        F.lit(0),
    )
    return {
        "completion_rate": (F.count_if(F.col("terminal_outcome") == "completed"), terminal),
        "cancellation_rate": (F.count_if(F.col("terminal_outcome") == "cancelled"), terminal),
        "rejection_rate": (F.count_if(F.col("terminal_outcome") == "rejected"), terminal),
        "stuck_case_rate": (F.count_if(F.col("is_stuck")), F.count_if(~ended)),
        "first_pass_completeness_rate": (
            F.count_if(F.col("first_pass_complete")),
            F.count("first_pass_complete"),
        ),
        "delayed_ingestion_rate": (F.count_if(F.col("delayed_event_count") > 0), cases),
        "out_of_order_ingestion_rate": (F.count_if(F.col("out_of_order_ingestion")), cases),
        "metric_availability_rate": (F.sum(usable), cases * len(METRICS)),
    }


def cohort_rollup(wide: DataFrame, spec: BaselineSpec) -> DataFrame:
    """Counts and rates per cohort, overall included: one aggregation for all dimensions."""
    parts = _rate_parts()
    aggs = [
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("terminal_outcome") == "completed").alias("completed"),
        F.count_if(F.col("terminal_outcome") == "cancelled").alias("cancelled"),
        F.count_if(F.col("terminal_outcome") == "rejected").alias("rejected"),
        F.count_if(F.col("is_stuck")).alias("stuck"),
    ]
    for name, (num, den) in parts.items():
        aggs += [num.alias(f"{name}_num"), den.alias(f"{name}_den")]
    got = members(wide, spec.dimensions).groupBy("dimension", "value").agg(*aggs)
    return got.withColumns(
        {n: F.try_divide(F.col(f"{n}_num"), F.col(f"{n}_den")) for n in parts}
        | {"eligible": F.col("cases") >= spec.min_cohort}
    )


def cohort_rates(rollup: DataFrame) -> DataFrame:
    """Long form: dimension, value, metric, numerator, denominator, rate."""
    entries = [
        F.struct(
            F.lit(n).alias("metric"),
            F.col(f"{n}_num").cast("long").alias("numerator"),
            F.col(f"{n}_den").cast("long").alias("denominator"),
            F.col(n).alias("rate"),
        )
        for n in RATES
    ]
    return rollup.select("dimension", "value", "cases", "eligible", F.inline(F.array(*entries)))


def _usable(metric: str) -> Column:
    ok = F.col(f"{metric}_status").isin("calculated", "estimated")
    return F.when(ok, F.col(metric).cast("double"))


def cohort_summaries(wide: DataFrame, spec: BaselineSpec, scale: Scale) -> DataFrame:
    """Per cohort and metric: n, excluded, mean, median and percentiles, long form."""
    narrow = wide.select(*spec.dimensions, *[_usable(m).alias(m) for m in SUMMARY_METRICS])
    cohort = members(narrow, spec.dimensions)
    names = ["n", "mean", "min", "max", "median", *[label(q) for q in (0.5, *spec.percentiles)]]
    names = list(dict.fromkeys(names))
    if scale.small:
        probs = tuple(dict.fromkeys((0.5, *spec.percentiles)))
        aggs = [F.count(F.lit(1)).alias("cases")]
        for m in SUMMARY_METRICS:
            aggs.append(
                F.struct(
                    F.count(m).alias("n"),
                    F.avg(m).alias("mean"),
                    F.percentile(m, F.array(*[F.lit(float(q)) for q in probs])).alias("q"),
                ).alias(m)
            )
        got = cohort.groupBy("dimension", "value").agg(*aggs)
        entries = [
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m)["n"].alias("n"),
                (F.col("cases") - F.col(m)["n"]).alias("excluded"),
                F.col(m)["mean"].alias("mean"),
                F.col(m)["q"][0].alias("median"),
                *[F.col(m)["q"][i].alias(label(q)) for i, q in enumerate(probs)],
            )
            for m in SUMMARY_METRICS
        ]
        return got.select("dimension", "value", "cases", F.inline(F.array(*entries)))
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("number")) for m in SUMMARY_METRICS
    ]
    long = cohort.select("dimension", "value", F.inline(F.array(*entries)))
    got = summarise(
        long,
        ["dimension", "value", "metric"],
        "number",
        spec.percentiles,
        scale,
        extra=[F.count(F.lit(1)).alias("cases")],
    )
    wanted = [label(q) for q in dict.fromkeys((0.5, *spec.percentiles))]
    return got.select(
        "dimension",
        "value",
        "cases",
        "metric",
        "n",
        (F.col("cases") - F.col("n")).alias("excluded"),
        "mean",
        "median",
        *wanted,
    )


def finding_rules(spark: SparkSession, rules=FINDING_RULES) -> DataFrame:
    rows = [
        (kind, metric, direction, dim, metric.endswith("_rate"))
        for kind, metric, direction, dims in rules
        for dim in dims
    ]
    return spark.createDataFrame(
        rows, "finding_type string, metric string, direction string, dimension string, is_rate boolean"
    )


def cohort_values(rollup: DataFrame, summaries: DataFrame, spec: BaselineSpec) -> DataFrame:
    """Every rate and every mean of every cohort in one long table."""
    rates = cohort_rates(rollup).select(
        "dimension", "value", "cases", "metric", F.col("rate").alias("observed"),
        F.col("denominator").alias("sample"),
    )
    means = summaries.select(
        "dimension", "value", "cases", "metric", F.col("mean").alias("observed"),
        F.col("n").alias("sample"),
    )
    return rates.unionByName(means).withColumn("eligible", F.col("cases") >= spec.min_cohort)


def findings(values: DataFrame, rules: DataFrame, spec: BaselineSpec) -> DataFrame:
    """Eligible cohorts that differ materially from the overall value of a rule's metric."""
    overall = values.where(F.col("dimension") == "overall").select(
        "metric", F.col("observed").alias("baseline"), F.col("cases").alias("baseline_cases")
    )
    diff = F.col("observed") - F.col("baseline")
    sign = F.when(F.col("direction") == "higher", 1.0).otherwise(-1.0)
    relative = F.when(F.col("baseline") != 0, diff / F.col("baseline"))
    strength = F.when(F.col("is_rate"), sign * diff).otherwise(sign * relative)
    limit = F.when(F.col("is_rate"), F.lit(spec.rate_threshold)).otherwise(
        F.lit(spec.relative_threshold)
    )
    return (
        values.where(F.col("eligible") & F.col("observed").isNotNull())
        .join(F.broadcast(rules), ["metric", "dimension"])
        .join(overall.where(F.col("baseline").isNotNull()), "metric")
        .where(strength >= limit)
        .select(
            F.translate(F.concat_ws("-", "dimension", "value", "finding_type"), "_", "-").alias(
                "finding_id"
            ),
            "finding_type",
            "dimension",
            "value",
            "metric",
            "direction",
            "is_rate",
            "observed",
            "baseline",
            diff.alias("absolute_difference"),
            relative.alias("relative_difference"),
            F.col("cases").alias("cohort_cases"),
            "baseline_cases",
            F.when(strength >= limit * 2, "strong").otherwise("material").alias("materiality"),
        )
    )


def finding_support(wide: DataFrame, found: DataFrame, spec: BaselineSpec, k: int = 25) -> DataFrame:
    """The first k supporting case ids of each finding."""
    signals = {
        "first_pass_completeness_rate": ~F.col("first_pass_complete"),
        "stuck_case_rate": F.col("is_stuck"),
        "delayed_ingestion_rate": F.col("delayed_event_count") > 0,
    }
    entries = [
        F.struct(F.lit(m).alias("metric"), F.when(hit, 1.0).alias("signal"))
        for m, hit in signals.items()
    ]
    used = {r[1] for r in FINDING_RULES} - set(signals)
    entries += [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("signal"))
        for m in sorted(used)
        if m not in BOOLEAN_METRICS
    ]
    dims = tuple(d for d in spec.dimensions)
    long = (
        members(wide, dims)
        .where(F.col("dimension") != "overall")
        .select("case_id", "dimension", "value", F.inline(F.array(*entries)))
        .where(F.col("signal").isNotNull())
    )
    marks = found.select(
        "finding_id", "dimension", "value", "metric", "direction", "is_rate", "baseline"
    )
    over = F.when(F.col("direction") == "higher", F.col("signal") > F.col("baseline")).otherwise(
        F.col("signal") < F.col("baseline")
    )
    hits = long.join(marks, ["dimension", "value", "metric"]).where(F.col("is_rate") | over)
    return first_ids(hits, ["finding_id"], "case_id", k, "supporting_case_ids")


def expected_labels(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Planted pattern against detection: hit, missed or extra.

    expected: (pattern, finding_types array, dimension, value).
    """
    exploded = expected.select("pattern", "dimension", "value", F.explode("finding_types").alias("finding_type"))
    hits = exploded.join(found, ["finding_type", "dimension", "value"], "left")
    judged = hits.groupBy("pattern", "dimension", "value").agg(
        F.count("finding_id").alias("matches"),
        F.coalesce(F.max("cohort_cases"), F.lit(0)).alias("sample_size"),
    )
    extra = (
        found.join(exploded, ["finding_type", "dimension", "value"], "left_anti")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("matches"), F.max("cohort_cases").alias("sample_size"))
        .select(F.lit("(extra)").alias("pattern"), "dimension", "value", "matches", "sample_size")
    )
    return judged.unionByName(extra).withColumn(
        "outcome",
        F.when(F.col("pattern") == "(extra)", "extra")
        .when(F.col("matches") > 0, "detected")
        .otherwise("missed"),
    )
