"""Token replay on distinct variants, deviations, and conformance summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.fold import fold
from ..functions.ordered import scan
from ..functions.stats import summarise
from ..session import Scale
from ..spec import ReferenceModel


def token_replay(steps: DataFrame, model: ReferenceModel) -> DataFrame:
    """Fitness of each sequence of flat (variant_id, pos, activity) rows.

    With a state machine as the model every fired step consumes and produces one
    token.  A label fires its first enabled transition; if none is enabled a missing
    token is put before its first declared transition.  Labels the model does not
    know are skipped.  The marking is carried along each sequence in order, so no
    task holds a whole one.  Fractional fitness follows the published definition;
    ties in choosing the missing token can make it differ from other tools, a
    fitness of exactly 1 cannot.
    """
    number = {state: i for i, state in enumerate(model.states)}
    options = {
        name: [(number[a], number[b]) for a, b, step in model.steps if step == name] for name in model.labels
    }
    start, final, places = number[model.start], number[model.end], len(model.states)

    def step(state, row):
        if state is None:
            state = ([int(i == start) for i in range(places)], [0, 0])
        tokens, (missing, fired) = state
        moves = options.get(row[0])
        if moves:
            enabled = next((m for m in moves if tokens[m[0]] > 0), None)
            if enabled:
                tokens[enabled[0]] -= 1
            tokens[(enabled or moves[0])[1]] += 1
            state[1][:] = missing + (enabled is None), fired + 1
        return state, None

    def end(state):
        tokens, (missing, fired) = state
        reached = tokens[final] > 0
        return missing + (not reached), sum(tokens) - reached, fired + 1

    got = fold(steps, "variant_id", ["pos"], ["activity"], "missing long, remaining long, moved long", step, end)
    missing, remaining, moved = F.col("missing"), F.col("remaining"), F.col("moved")
    return got.select(
        "variant_id",
        "missing",
        "remaining",
        moved.alias("consumed"),
        moved.alias("produced"),
        (F.lit(0.5) * (1 - missing / moved) + F.lit(0.5) * (1 - remaining / moved)).alias("fitness"),
    )


def _counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("variant_id", "activity").agg(F.count(F.lit(1)).alias("n"))


def _found(rows: DataFrame, category: str, activity=None, pos=None) -> DataFrame:
    return rows.select(
        "variant_id",
        F.lit(category).alias("category"),
        (activity if activity is not None else F.lit(None).cast("string")).alias("activity"),
        (pos if pos is not None else F.lit(None)).cast("long").alias("pos"),
    )


def _terminal_deviations(steps: DataFrame, model: ReferenceModel, strict: bool) -> DataFrame:
    terminal = F.col("activity").isin(*model.terminals)
    spot = F.struct("pos", "activity")
    ends = steps.groupBy("variant_id").agg(
        F.max(spot)["activity"].alias("last"),
        F.max(F.when(terminal, spot))["activity"].alias("last_terminal"),
    )
    none = F.col("last_terminal").isNull()
    out = _found(ends.where(none), "missing_terminal_event").unionByName(
        _found(ends.where(~none & ~F.col("last").isin(*model.terminals)), "early_termination")
    )
    if strict:
        goal = model.sequence[-1]
        out = out.unionByName(
            _found(
                ends.where(F.col("last_terminal") != goal),
                "unexpected_terminal_event",
                F.col("last_terminal"),
            )
        )
    return out


def strict_deviations(steps: DataFrame, model: ReferenceModel, scale: Scale) -> DataFrame:
    """Deviations of each variant from a chain: (variant_id, category, activity, pos)."""
    counts = _counts(steps)
    spark = steps.sparkSession
    wanted = spark.createDataFrame(
        list(enumerate(model.sequence)), "idx int, activity string"
    )
    seen = steps.select("variant_id").distinct()
    missing = (
        seen.select("variant_id", F.explode(F.array(*[F.lit(a) for a in model.sequence])).alias("activity"))
        .join(counts, ["variant_id", "activity"], "left_anti")
    )
    known = F.col("activity").isin(*model.sequence)
    indexed = steps.join(F.broadcast(wanted), "activity")
    ordered = scan(indexed, ["variant_id"], ["pos"], scale, previous={"before": F.col("idx")})
    disorder = ordered.where(F.col("before") > F.col("idx")).select("variant_id").distinct()
    return (
        _found(missing, "missing_activity", F.col("activity"))
        .unionByName(
            _found(steps.where(~known), "unexpected_activity", F.col("activity"), F.col("pos"))
        )
        .unionByName(_found(counts.where(known & (F.col("n") > 1)), "activity_repeated", F.col("activity")))
        .unionByName(_found(disorder, "unexpected_order"))
        .unionByName(_terminal_deviations(steps, model, strict=True))
    )


# fixed values: activities limited to one occurrence, looping, and retrying
LIMITED = {
    "Referral recategorised": "unexpected_recategorisation",
    "Clinical team reassigned": "unexpected_reassignment",
}
LOOPING = "Missing information requested"
RETRYING = "Scheduling failed"


def governed_deviations(
    steps: DataFrame,
    replay: DataFrame,
    model: ReferenceModel,
    limited=None,
    looping: str = LOOPING,
    retrying: str = RETRYING,
) -> DataFrame:
    """Deviations from a process with exceptions; order only when nothing else explains it."""
    limited = LIMITED if limited is None else limited
    counts = _counts(steps)
    out = _found(
        steps.where(~F.col("activity").isin(*model.labels)),
        "unsupported_activity",
        F.col("activity"),
        F.col("pos"),
    )
    for activity, category in limited.items():
        over = counts.where((F.col("activity") == activity) & (F.col("n") > 1))
        out = out.unionByName(_found(over, category, F.col("activity")))
        out = out.unionByName(_found(over, "excessive_loop", F.col("activity")))
    out = (
        out.unionByName(
            _found(
                counts.where((F.col("activity") == looping) & (F.col("n") > 1)),
                "excessive_loop",
                F.col("activity"),
            )
        )
        .unionByName(
            _found(counts.where(F.col("activity") == retrying), "scheduling_retry", F.col("activity"))
        )
        .unionByName(_terminal_deviations(steps, model, strict=False))
    )
    unfit = replay.where(F.col("fitness") < 1).join(
        out.select("variant_id"), "variant_id", "left_anti"
    )
    return out.unionByName(_found(unfit, "unexpected_order"))


def conformance_status(
    replay: DataFrame, deviations: DataFrame, tolerated: tuple[str, ...] = ()
) -> DataFrame:
    """full iff fitness is 1 and nothing but tolerated deviations; partial above 0; else non."""
    serious = deviations.where(~F.col("category").isin(*tolerated)) if tolerated else deviations
    counts = deviations.groupBy("variant_id").agg(F.count(F.lit(1)).alias("deviations"))
    hard = serious.select("variant_id").distinct().withColumn("_hard", F.lit(True))
    return (
        replay.join(counts, "variant_id", "left")
        .join(hard, "variant_id", "left")
        .select(
            "variant_id",
            "fitness",
            (F.col("missing") + F.col("remaining")).alias("alignment_cost"),
            F.coalesce("deviations", F.lit(0)).alias("deviations"),
            F.when((F.col("fitness") == 1) & F.col("_hard").isNull(), "fully_conforming")
            .when(F.col("fitness") > 0, "partially_conforming")
            .otherwise("non_conforming")
            .alias("conformance"),
        )
    )


def variant_conformance(cores: DataFrame, strict: DataFrame, governed: DataFrame) -> DataFrame:
    """(variant_id, cases) with mean fitness and the share of fully conforming cases against both models.

    All cases of a variant replay alike, so its means are the values of the variant.
    """
    out = cores.select("variant_id", "cases")
    for name, status in (("strict", strict), ("governed", governed)):
        full = F.when(F.col("conformance") == "fully_conforming", 1.0).otherwise(0.0)
        part = status.select("variant_id", F.col("fitness").alias(f"{name}_fitness"), full.alias(f"{name}_full_rate"))
        out = out.join(part, "variant_id", "left")
    return out


def case_conformance(cases: DataFrame, status: DataFrame) -> DataFrame:
    """Carry the variant results back to the cases; a variant without replay is unavailable."""
    return cases.join(status, "variant_id", "left").withColumn(
        "conformance", F.coalesce("conformance", F.lit("unavailable"))
    )


def conformance_summary(
    results: DataFrame, scale: Scale, dimensions: tuple[str, ...] = ("status", "referral_source", "service_line")
) -> DataFrame:
    """Overall and per cohort: counts, fitness and rates over the available results."""
    pairs = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    pairs += [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]
    rows = results.select("fitness", "conformance", F.inline(F.array(*pairs))).where(
        F.col("value").isNotNull()
    )
    got = summarise(
        rows,
        ["dimension", "value"],
        "fitness",
        (0.5,),
        scale,
        extra=[
            F.count(F.lit(1)).alias("cases"),
            F.count_if(F.col("conformance") == "fully_conforming").alias("full"),
            F.count_if(F.col("conformance") == "partially_conforming").alias("partial"),
            F.count_if(F.col("conformance") == "non_conforming").alias("non"),
        ],
    )
    return got.select(
        "dimension",
        "value",
        "cases",
        F.col("n").alias("available"),
        (F.col("cases") - F.col("n")).alias("unavailable"),
        F.col("mean").alias("mean_fitness"),
        F.col("median").alias("median_fitness"),
        F.try_divide("full", "n").alias("full_rate"),
        F.try_divide("partial", "n").alias("partial_rate"),
        F.try_divide("non", "n").alias("non_rate"),
    )


def deviation_counts(cores: DataFrame, deviations: DataFrame) -> DataFrame:
    """Deviations over cases by category: each variant counts once per case."""
    return (
        deviations.groupBy("variant_id", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(cores.select("variant_id", "cases"), "variant_id")
        .groupBy("category")
        .agg(F.sum(F.col("n") * F.col("cases")).alias("deviations"))
    )


def activity_deviations(cores: DataFrame, deviations: DataFrame) -> DataFrame:
    return (
        deviations.where(F.col("activity").isNotNull())
        .join(cores.select("variant_id", "cases"), "variant_id")
        .groupBy("activity")
        .agg(F.sum("cases").alias("deviations"))
    )


def deviating_edges(paths: DataFrame, cores: DataFrame, status: DataFrame) -> DataFrame:
    """Cases with any deviation that use each edge (paths: variant steps with next_activity)."""
    bad = status.where(F.col("deviations") > 0).select("variant_id")
    return (
        paths.where(F.col("next_activity").isNotNull())
        .join(bad, "variant_id", "left_semi")
        .select("variant_id", F.col("activity").alias("source"), F.col("next_activity").alias("target"))
        .distinct()
        .join(cores.select("variant_id", "cases"), "variant_id")
        .groupBy("source", "target")
        .agg(F.sum("cases").alias("deviating_cases"))
    )
