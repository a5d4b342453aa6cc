"""Variants: cases grouped by their whole activity sequence, and log complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..functions.ordered import scan
from ..functions.stats import first_ids, label, summarise
from ..session import Scale, pin
from ..spec import MiningSpec

# fixed values: marker of each activity
MARKERS = {
    "Missing information requested": "missing_information",
    "Referral recategorised": "recategorisation",
    "Clinical team reassigned": "reassignment",
    "Scheduling failed": "failed_scheduling",
    "Referral cancelled": "cancellation",
    "Referral rejected": "rejection",
}


def sequence_keys(log: DataFrame) -> DataFrame:
    """(case_id, key, length): equal keys for equal sequences.

    The key combines a hash of every (position, activity) with exclusive or, twice with other seeds
    (128 bits).  It needs neither order nor a whole sequence: parts of a case add up before the
    shuffle and in any order, however long the case.
    """
    mixed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("pos").cast("long"), "activity"))
    keys = log.groupBy("case_id").agg(mixed(1).alias("a"), mixed(2).alias("b"), F.count(F.lit(1)).alias("length"))
    return keys.select("case_id", F.struct("a", "b", "length").alias("key"), "length")


def sequence_digests(log: DataFrame, version: str, scale: Scale) -> DataFrame:
    """(case_id, digest): SHA-256 of the sequence as JSON.

    Sequences that one task can hold are joined on the JVM; longer ones are fed to the hash
    activity by activity in order.
    """
    quoted = F.to_json(F.array("activity"))
    pieces = log.select("case_id", "pos", F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("piece"))
    begin, close = '{"activities":[', f'],"activity_mapping_version":"{version}"}}'

    def joined(rows: DataFrame) -> DataFrame:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"])
        text = F.concat(F.lit(begin), F.array_join(listed, ","), F.lit(close))
        return rows.groupBy("case_id").agg(F.sha2(text.cast("binary"), 256).alias("digest"))

    if scale.fits("case_id"):
        return joined(pieces)
    sizes = pieces.groupBy("case_id").agg((F.count(F.lit(1)) > scale.limit).alias("long"))
    sizes = pin(sizes)
    if sizes.where("long").isEmpty():
        return joined(pieces)

    def step(state, row):
        import hashlib

        if state is None:
            state = [hashlib.sha256(begin.encode()), False]
        state[0].update((b"," if state[1] else b"") + row[0].encode())
        state[1] = True
        return state, None

    def end(state):
        state[0].update(close.encode())
        return (state[0].hexdigest(),)

    long = pieces.join(sizes.where("long").select("case_id"), "case_id", "left_semi")
    short = pieces.join(sizes.where("long").select("case_id"), "case_id", "left_anti")
    return joined(short).unionByName(fold(long, "case_id", ["pos"], ["piece"], "digest string", step, end))


def case_digests(log: DataFrame, version: str = "activity-map-v1", scale: Scale | None = None) -> DataFrame:
    """(case_id, digest, length) of every case, where each one's own SHA-256 is wanted."""
    digests = sequence_digests(log, version, scale or Scale.of(log, "case_id"))
    return digests.join(log.groupBy("case_id").agg(F.count(F.lit(1)).alias("length")), "case_id")


def case_variants(log: DataFrame, spec: MiningSpec, scale: Scale | None = None) -> DataFrame:
    """(case_id, variant_id, length); the id shows the whole SHA-256 of the sequence, taken from one case of the variant."""
    scale = scale or Scale.of(log, "case_id")
    keys = sequence_keys(log)
    first = keys.groupBy("key").agg(F.min("case_id").alias("case_id"))
    digests = sequence_digests(log.join(first.select("case_id"), "case_id", "left_semi"), spec.mapping_version, scale)
    names = first.join(digests, "case_id").select("key", F.concat(F.lit("variant-"), "digest").alias("variant_id"))
    return keys.join(names, "key").select("case_id", "variant_id", "length")


def variant_class(spec: MiningSpec) -> Column:
    return (
        F.when(F.col("cases") <= spec.rare_variant, "rare")
        .when(F.col("cases") >= spec.min_variant, "common")
        .otherwise("uncommon")
    )


def variant_cores(cases: DataFrame, spec: MiningSpec) -> DataFrame:
    """(variant_id, cases, representative, length, class)"""
    return (
        cases.groupBy("variant_id")
        .agg(
            F.count(F.lit(1)).alias("cases"),
            F.min("case_id").alias("representative"),
            F.max("length").alias("length"),
        )
        .withColumn("class", variant_class(spec))
    )


def variant_events(log: DataFrame, cores: DataFrame) -> DataFrame:
    """The sequence of each variant as flat rows, taken from one representative case."""
    picked = cores.select("variant_id", F.col("representative").alias("case_id"))
    return log.select("case_id", "pos", "activity").join(picked, "case_id").select(
        "variant_id", "pos", "activity"
    )


def variant_activity_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("variant_id", "activity").agg(F.count(F.lit(1)).alias("n"))


def variant_markers(steps: DataFrame, spec: MiningSpec, markers=MARKERS) -> DataFrame:
    counts = variant_activity_counts(steps)
    tests = [
        (name, F.bool_or(F.col("activity") == activity)) for activity, name in markers.items()
    ]
    tests.append(
        ("open_or_stuck", ~F.bool_or(F.col("activity").isin(*spec.terminal_activities)))
    )
    tests.append(("repeated_activity", F.bool_or(F.col("n") > 1)))
    listed = F.array(*[F.when(test, F.lit(name)) for name, test in tests])
    return counts.groupBy("variant_id").agg(
        F.filter(listed, lambda x: x.isNotNull()).alias("markers")
    )


def distribution(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Map of value → count per group (value from a closed vocabulary)."""
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_c")))).alias(name)
    )


def variants(cases: DataFrame, wide: DataFrame, spec: MiningSpec, scale: Scale) -> DataFrame:
    """One row per variant: size, share, class, durations and mean effort."""
    joined = cases.join(wide, "case_id", "left").withColumn(
        "_closed",
        F.when(F.col("case_duration_hours_status") == "calculated", F.col("case_duration_hours")),
    )
    total = cases.agg(F.count(F.lit(1)).alias("traces"))
    got = summarise(
        joined,
        ["variant_id"],
        "_closed",
        spec.percentiles,
        scale,
        prefix="duration_",
        extra=[
            F.count(F.lit(1)).alias("cases"),
            F.max("length").alias("length"),
            F.min("case_id").alias("representative"),
            F.avg("manual_touches").alias("mean_manual_touches"),
            F.avg("handoffs").alias("mean_handoffs"),
            F.avg("rework_count").alias("mean_rework"),
            F.avg(F.col("first_pass_complete").cast("int")).alias("first_pass_rate"),
        ],
    )
    return (
        got.crossJoin(F.broadcast(total))
        .withColumn("share", F.try_divide(F.col("cases"), F.col("traces")))
        .withColumn("class", variant_class(spec))
        .drop("traces")
    )


def variant_profile(cases: DataFrame, wide: DataFrame) -> DataFrame:
    """Outcome, service and source distributions per variant."""
    joined = cases.join(wide.select("case_id", "terminal_outcome", "service_line", "referral_source"), "case_id")
    parts = [
        distribution(joined, "variant_id", "terminal_outcome", "outcomes"),
        distribution(joined, "variant_id", "service_line", "service_lines"),
        distribution(joined, "variant_id", "referral_source", "referral_sources"),
    ]
    return reduce(lambda a, b: a.join(b, "variant_id", "left"), parts)


def variant_support(cases: DataFrame, k: int = 10) -> DataFrame:
    return first_ids(cases, ["variant_id"], "case_id", k, "representative_case_ids")


def topk_variants(cores: DataFrame, k: int) -> DataFrame:
    return cores.orderBy(F.desc("cases"), "variant_id").limit(k)


def cumulative_coverage(cores: DataFrame, scale: Scale) -> DataFrame:
    """Variants from the most to the least frequent with their running share of cases."""
    one = cores.withColumns({"_all": F.lit(1), "_down": -F.col("cases")})
    got = scan(
        one,
        ["_all"],
        ["_down", "variant_id"],
        scale,
        position="_p",
        running={"_upto": F.col("cases")},
        totals={"_sum": F.col("cases")},
    )
    return got.select(
        "variant_id",
        "cases",
        (F.col("_p") + 1).alias("rank"),
        F.try_divide(F.col("_upto"), F.col("_sum")).alias("coverage"),
    )


def complexity(
    log: DataFrame, cases: DataFrame, cores: DataFrame, wide: DataFrame, scale: Scale
) -> DataFrame:
    """Log-level measures, long form (measure, number).

    The rework and hand-off numerators run over all analysed cases, the
    denominators over traces.
    """
    top = topk_variants(cores, 10).select("cases").agg(
        F.reverse(F.array_sort(F.collect_list("cases"))).alias("tops")
    )
    lengths = summarise(cases, [], "length", (0.5,), scale)
    repeats = (
        log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("case_id").agg(F.max("n").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("loop_cases"))
    )
    counts = log.agg(
        F.count_distinct("activity").alias("activities"),
        F.count_distinct(F.when(F.col("next_activity").isNull(), F.col("activity"))).alias("ends"),
    )
    pairs = log.where(F.col("next_activity").isNotNull()).groupBy("activity", "next_activity").agg(
        F.lit(1)
    ).agg(F.count(F.lit(1)).alias("transitions"))
    share = F.col("cases") / F.col("traces")
    spread = (
        cores.crossJoin(F.broadcast(cases.agg(F.count(F.lit(1)).alias("traces"))))
        .agg(
            F.count(F.lit(1)).alias("variants"),
            F.count_if(F.col("class") == "rare").alias("rare"),
            (-F.sum(share * F.log2(share))).alias("entropy"),
            F.max("traces").alias("traces"),
        )
    )
    effort = wide.agg(
        F.count_if(F.col("rework_count") > 0).alias("rework_cases"),
        F.count_if(F.col("handoffs") > 0).alias("handoff_cases"),
    )
    # every input below is a one-row aggregate
    row = spread.crossJoin(top).crossJoin(lengths).crossJoin(repeats).crossJoin(counts)
    row = row.crossJoin(pairs).crossJoin(effort)

    def covered(k: int) -> Column:
        return F.aggregate(
            F.slice("tops", 1, k), F.lit(0).cast("long"), lambda acc, x: acc + x
        ) / F.col("traces")

    measures = {
        "distinct_activity_count": F.col("activities"),
        "distinct_transition_count": F.col("transitions"),
        "distinct_variant_count": F.col("variants"),
        "top_1_variant_coverage": covered(1),
        "top_5_variant_coverage": covered(5),
        "top_10_variant_coverage": covered(10),
        "long_tail_variant_count": F.col("rare"),
        "mean_activities_per_case": F.col("mean"),
        "median_activities_per_case": F.col("median"),
        "maximum_activities_per_case": F.col("max"),
        "loop_case_rate": F.col("loop_cases") / F.col("traces"),
        "rework_case_rate": F.col("rework_cases") / F.col("traces"),
        "handoff_case_rate": F.col("handoff_cases") / F.col("traces"),
        "terminal_path_diversity": F.col("ends"),
        "variant_entropy_bits": F.col("entropy"),
    }
    pairs_ = [
        F.struct(F.lit(n).alias("measure"), e.cast("double").alias("number"))
        for n, e in measures.items()
    ]
    return row.select(F.inline(F.array(*pairs_)))


def variant_paths(steps: DataFrame, scale: Scale) -> DataFrame:
    """Node and edge ids of each variant as flat rows (position, activity, next activity)."""
    return scan(
        steps, ["variant_id"], ["pos"], scale, following={"next_activity": F.col("activity")}
    )
