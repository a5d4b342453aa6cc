"""Directly-follows statistics, loops and log preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.calendar import MICROS_HOUR, business_micros, hours_between
from ..functions.ids import node_id, transition_id
from ..functions.ordered import scan
from ..functions.stats import first_ids, label, summarise
from ..session import Scale
from ..spec import BaselineSpec, MiningSpec
from .timeline import ORDER, deduplicate, filter_period

CASE_ATTRIBUTES = ("status", "referral_source", "service_line")


def activity_mapping(spark: SparkSession, labels=None) -> DataFrame:
    return spark.createDataFrame(
        list((labels or vocab.ACTIVITY_LABELS).items()), "event_type string, activity string"
    )


def map_activity(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the activity label; events of unmapped types are dropped."""
    return events.join(F.broadcast(mapping), "event_type")


def unmapped_types(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event types without a label, with their number of events (empty = total mapping)."""
    return (
        events.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .join(mapping, "event_type", "left_anti")
    )


def process_log(
    events: DataFrame,
    cases: DataFrame,
    mapping: DataFrame,
    spec: BaselineSpec,
    scale: Scale,
) -> DataFrame:
    """One row per kept event: case attributes, activity, position and neighbours."""
    known = filter_period(cases, spec).where(F.col("schema_version") == spec.schema_version)
    attrs = known.select("case_id", *[F.col(c) for c in CASE_ATTRIBUTES])
    kept = deduplicate(events.join(attrs, "case_id"), scale)
    bad = F.when(F.col("schema_version") != spec.schema_version, 1).otherwise(0)
    kept = scan(kept, ["case_id"], ORDER, scale, totals={"_bad": bad}).where(F.col("_bad") == 0)
    if spec.reject_duplicates:
        extra = (
            events.groupBy("case_id", "source_system", "external_event_id")
            .count()
            .where("count > 1")
            .select("case_id")
        )
        kept = kept.join(extra, "case_id", "left_anti")
    return neighbours(map_activity(kept.drop("_bad"), mapping), scale)


def neighbours(rows: DataFrame, scale: Scale, order: list[str] | None = None) -> DataFrame:
    """Position and the next event's values on each row: the only window the edges need."""
    order = order or ORDER
    owner = F.coalesce("team_id", "actor_id")
    return scan(
        rows.withColumn("owner", owner),
        ["case_id"],
        order,
        scale,
        position="pos",
        following={
            "next_activity": F.col("activity"),
            "next_at": F.col("event_at"),
            "next_manual": F.col("manual"),
            "next_actor_type": F.col("actor_type"),
            "next_owner": F.col("owner"),
        },
    )


def simple_log(rows: DataFrame, scale: Scale) -> DataFrame:
    """Neighbours for any log with case_id, activity, event_at, event_id."""
    return scan(
        rows,
        ["case_id"],
        ORDER,
        scale,
        position="pos",
        following={"next_activity": F.col("activity"), "next_at": F.col("event_at")},
    )


def edges(log: DataFrame) -> DataFrame:
    """Directly-follows pairs with elapsed hours."""
    return log.where(F.col("next_activity").isNotNull()).withColumns(
        {
            "source": F.col("activity"),
            "target": F.col("next_activity"),
            "hours": hours_between(F.col("event_at"), F.col("next_at")),
        }
    )


def handoff(spec: MiningSpec) -> Column:
    """Both ends internal and their owners (team, else actor) known and different."""
    both = F.col("actor_type").isin(*spec.internal_actors) & F.col("next_actor_type").isin(
        *spec.internal_actors
    )
    return F.coalesce(both & (F.col("owner") != F.col("next_owner")), F.lit(False))


def trace_count(log: DataFrame) -> DataFrame:
    return log.where(F.col("pos") == 0).agg(F.count(F.lit(1)).alias("traces"))


def transition_stats(log: DataFrame, spec: MiningSpec, scale: Scale) -> DataFrame:
    """One row per edge: counts, shares, elapsed and working-time summaries, rates.

    One pass over the log.  The last event of each trace has no target, so the
    groups without a target count the traces; the first occurrence of an edge
    inside its case is marked in the case's own partition, so cases are counted
    without a distinct aggregate.
    """
    rows = log.withColumns(
        {
            "source": F.col("activity"),
            "target": F.col("next_activity"),
            "hours": hours_between(F.col("event_at"), F.col("next_at")),
            "work": business_micros(F.col("event_at"), F.col("next_at"), spec.calendar)
            / F.lit(float(MICROS_HOUR)),
        }
    )
    marked = scan(rows, ["case_id", "source", "target"], ["pos"], scale, position="_nth")
    rework = F.col("target").isin(*spec.rework_activities) | (F.col("source") == F.col("target"))
    got = summarise(
        marked,
        ["source", "target"],
        "hours",
        spec.percentiles,
        scale,
        prefix="hours_",
        also={"work_": "work"},
        extra=[
            F.count(F.lit(1)).alias("frequency"),
            F.count_if(F.col("_nth") == 0).alias("cases"),
            F.avg((F.col("manual") | F.col("next_manual")).cast("int")).alias("manual_rate"),
            F.avg(handoff(spec).cast("int")).alias("handoff_rate"),
            F.avg(rework.cast("int")).alias("rework_rate"),
        ],
    )
    # one row per pair of activities: a window over all of them is small for any log
    everything = Window.partitionBy(F.lit(1))
    traces = F.sum(F.when(F.col("target").isNull(), F.col("frequency"))).over(everything)
    return (
        got.withColumn("case_share", F.try_divide(F.col("cases"), traces))
        .where(F.col("target").isNotNull())
        .withColumns(
            {
                "transition_id": transition_id(F.col("source"), F.col("target")),
                "terminal": F.col("target").isin(*spec.terminal_activities),
            }
        )
    )


def transition_support(log: DataFrame, k: int = 25) -> DataFrame:
    return first_ids(edges(log), ["source", "target"], "case_id", k, "supporting_case_ids")


def filter_edges(stats: DataFrame, spec: MiningSpec) -> DataFrame:
    return (
        stats.where(F.col("frequency") >= spec.edge_min)
        .orderBy(F.desc("frequency"), "source", "target")
        .limit(spec.edge_max)
    )


def activity_stats(log: DataFrame) -> DataFrame:
    per_case = log.groupBy("activity", "case_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("manual")).alias("m"),
        F.sum("pos").alias("p"),
    )
    return per_case.groupBy("activity").agg(
        F.sum("n").alias("frequency"),
        F.count(F.lit(1)).alias("cases"),
        (F.sum("m") / F.sum("n")).alias("manual_rate"),
        (F.sum("p") / F.sum("n")).alias("mean_position"),
        F.count_if(F.col("n") > 1).alias("repeating_cases"),
    )


def start_end_counts(log: DataFrame) -> DataFrame:
    ends = F.filter(
        F.array(
            F.when(F.col("pos") == 0, F.lit("start")),
            F.when(F.col("next_activity").isNull(), F.lit("end")),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        log.select("activity", F.explode(ends).alias("side"))
        .groupBy("side", "activity")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def dfg_frequency(log: DataFrame) -> DataFrame:
    return edges(log).groupBy("source", "target").agg(F.count(F.lit(1)).alias("frequency"))


def dfg_performance(log: DataFrame, scale: Scale) -> DataFrame:
    return summarise(
        edges(log),
        ["source", "target"],
        "hours",
        (0.5,),
        scale,
        extra=[F.stddev("hours").alias("stddev"), F.sum("hours").alias("sum")],
    ).drop("p50")


def dfg_by_self_lookup(rows: DataFrame) -> DataFrame:
    """The same graph built another way: join each position to the following one."""
    left = rows.select("case_id", "pos", F.col("activity").alias("source"))
    right = rows.select("case_id", (F.col("pos") - 1).alias("pos"), F.col("activity").alias("target"))
    return (
        left.join(right, ["case_id", "pos"])
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def dfg_reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Compare two edge → frequency tables; `differing` is 0 when they agree."""
    both = a.join(b.withColumnRenamed("frequency", "other"), ["source", "target"], "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(~F.col("frequency").eqNullSafe(F.col("other"))).alias("differing"),
    )


def self_loops(log: DataFrame, scale: Scale) -> DataFrame:
    got = edges(log).where(F.col("source") == F.col("target"))
    return _loops(got.select("case_id", "source", F.lit(None).cast("string").alias("via"), "hours"), "self_loop", scale)


def two_step_loops(log: DataFrame, scale: Scale) -> DataFrame:
    """A → B → A with A ≠ B; hours run from the first A to the last."""
    ahead = scan(
        log,
        ["case_id"],
        ["pos"],
        scale,
        following={
            "third_activity": F.col("next_activity"),
            "third_at": F.col("next_at"),
        },
    )
    got = ahead.where(
        (F.col("activity") == F.col("third_activity"))
        & (F.col("activity") != F.col("next_activity"))
    ).select(
        "case_id",
        F.col("activity").alias("source"),
        F.col("next_activity").alias("via"),
        hours_between(F.col("event_at"), F.col("third_at")).alias("hours"),
    )
    return _loops(got, "two_step_loop", scale)


def _loops(rows: DataFrame, kind: str, scale: Scale) -> DataFrame:
    summary = summarise(
        rows, ["source", "via"], "hours", (0.5,), scale, extra=[F.count(F.lit(1)).alias("occurrences")]
    )
    cases = (
        rows.groupBy("source", "via", "case_id").agg(F.lit(1)).groupBy("source", "via").agg(
            F.count(F.lit(1)).alias("cases")
        )
    )
    tagged = cases.select(F.col("source").alias("_s"), F.col("via").alias("_v"), "cases")
    match = (F.col("source") == F.col("_s")) & F.col("via").eqNullSafe(F.col("_v"))
    return summary.join(tagged, match).select(
        F.concat(
            F.lit("self-" if kind == "self_loop" else "two-step-"),
            transition_id(F.col("source"), F.coalesce("via", "source")),
        ).alias("loop_id"),
        F.lit(kind).alias("loop_type"),
        "source",
        "via",
        "occurrences",
        "cases",
        F.col("median").alias("median_hours"),
    )


def graph_nodes(
    activities: DataFrame, starts: DataFrame, deviations: DataFrame, spec: MiningSpec
) -> DataFrame:
    """deviations: (activity, deviations) counts over cases."""
    first = starts.where(F.col("side") == "start").select("activity", F.lit(True).alias("is_start"))
    return (
        activities.join(first, "activity", "left")
        .join(deviations, "activity", "left")
        .select(
            node_id(F.col("activity")).alias("node_id"),
            "activity",
            "frequency",
            "cases",
            F.coalesce("is_start", F.lit(False)).alias("is_start"),
            F.col("activity").isin(*spec.terminal_activities).alias("is_terminal"),
            "manual_rate",
            "mean_position",
            F.col("repeating_cases").alias("rework_cases"),
            F.coalesce("deviations", F.lit(0)).alias("deviations"),
        )
    )


def graph_edges(
    stats: DataFrame, candidates: DataFrame, deviating: DataFrame
) -> DataFrame:
    """deviating: (source, target, deviating_cases); candidates: bottleneck rows."""
    slow = candidates.where(F.col("subject").contains(" -> ")).groupBy("subject").agg(
        F.max_by("materiality", "candidate_id").alias("bottleneck")
    )
    return (
        stats.join(deviating, ["source", "target"], "left")
        .withColumn("subject", F.concat_ws(" -> ", "source", "target"))
        .join(slow, "subject", "left")
        .select(
            F.col("transition_id").alias("edge_id"),
            node_id(F.col("source")).alias("source_node"),
            node_id(F.col("target")).alias("target_node"),
            "frequency",
            "cases",
            "hours_median",
            *[f"hours_{label(q)}" for q in (0.75, 0.9, 0.95)],
            "work_median",
            "handoff_rate",
            "rework_rate",
            F.try_divide(F.coalesce("deviating_cases", F.lit(0)), F.col("cases")).alias(
                "deviation_rate"
            ),
            "bottleneck",
        )
    )
