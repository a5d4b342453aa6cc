"""Altered event logs: eligibility, overlay, change log, checks and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import MICROS_HOUR, hours_between, plus_micros
from ..functions.ids import SEP, stable_id
from ..functions.ordered import scan
from ..session import Scale
from ..spec import BaselineSpec, Roles
from .quality import top_level_forbidden, violations
from .timeline import ORDER, orphan_events

TREATED_KEY = "simulation_intervention_id"
# fixed values: expected effect of the intervention on each metric
EFFECTS = {
    "manual_touches": "intended_direct_effect",
    "rework_count": "intended_direct_effect",
    "time_to_first_completeness_check_hours": "intended_direct_effect",
    "case_duration_hours": "secondary_effect",
    "waiting_time_business_hours": "secondary_effect",
    "handoffs": "unchanged",
    "failed_scheduling_attempts": "unchanged",
}


def case_eligibility(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, cohort: tuple[str, str]
) -> DataFrame:
    """(case_id, reasons, eligible): every reason that keeps a case out, in a fixed order."""
    r = spec.roles
    kind = F.col("event_type")
    facts = events.groupBy("case_id").agg(
        F.min(F.when(kind == r.received, F.col("event_at"))).alias("_received"),
        F.min(F.when(kind == r.check, F.col("event_at"))).alias("_check"),
        F.bool_or(F.col("schema_version") != spec.schema_version).alias("_version"),
        F.bool_or(F.get_json_object("metadata", f"$.{TREATED_KEY}").isNotNull()).alias("_treated"),
    )
    dim, value = cohort
    checks = {
        "outside_cohort": F.col(dim) != value,
        "unsupported_schema_version": (F.col("schema_version") != spec.schema_version)
        | F.coalesce("_version", F.lit(False)),
        "missing_received_event": F.col("_received").isNull(),
        "missing_check_event": F.col("_check").isNull(),
        "unsupported_event_sequence": F.col("_check") < F.col("_received"),
        "before_period": (F.col("received_at") < F.lit(spec.period_start))
        if spec.period_start
        else F.lit(False),
        "after_period": (F.col("received_at") >= F.lit(spec.period_end))
        if spec.period_end
        else F.lit(False),
        "already_treated": F.col("_treated"),
    }
    return (
        cases.join(facts, "case_id", "left")
        .select("case_id", violations(checks).alias("reasons"))
        .withColumn("eligible", F.size("reasons") == 0)
    )


def rollout_draw(case_id: Column, seed: str, version: str) -> Column:
    """A number in [0, 1) that depends only on seed, case and version."""
    digest = F.sha2(F.concat_ws(SEP, F.lit(seed), case_id.cast("string"), F.lit(version)), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("double") / F.lit(float(16**15))


def rollout_assignment(cases: DataFrame, seed: str, version: str, share: float) -> DataFrame:
    draw = rollout_draw(F.col("case_id"), seed, version)
    return cases.withColumn("draw", draw).withColumn("selected", F.col("draw") < share)


def approved_cases(
    eligibility: DataFrame,
    events: DataFrame,
    spec: BaselineSpec,
    scale: Scale,
    *,
    seed: str,
    version: str,
    share: float,
    most: int | None = None,
) -> DataFrame:
    """Eligible cases with a request that the rollout selects; optionally the first `most` by id."""
    asked = events.where(F.col("event_type") == spec.roles.request).select("case_id").distinct()
    picked = rollout_assignment(
        eligibility.where("eligible").select("case_id").join(asked, "case_id", "left_semi"),
        seed,
        version,
        share,
    ).where("selected")
    if most is not None:
        picked = scan(
            picked.withColumn("_all", F.lit(1)), ["_all"], ["case_id"], scale, position="_n"
        ).where(F.col("_n") < most)
    return picked.select("case_id")


def with_hours(approved: DataFrame, review_hours: float, system_hours: float) -> DataFrame:
    return approved.withColumns(
        {"review_hours": F.lit(review_hours), "system_hours": F.lit(system_hours)}
    )


def anchors(events: DataFrame, approved: DataFrame, roles: Roles) -> DataFrame:
    """First receipt, check and request of each approved case (case, review_hours, system_hours)."""
    spot = F.struct(*ORDER)

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, spot))

    return (
        events.join(approved.select("case_id"), "case_id", "left_semi")
        .groupBy("case_id")
        .agg(
            first(roles.received).alias("a_received"),
            first(roles.check).alias("a_check"),
            first(roles.request).alias("a_request"),
        )
        .join(approved, "case_id")
    )


def event_overlay(
    events: DataFrame, approved: DataFrame, roles: Roles, run_id: str
) -> DataFrame:
    """All events, those of approved cases rewritten.

    The first check and the first request move to shortly after the receipt;
    everything after the request keeps its distance to it.  The first check and
    later checks become system work.  New rows carry the id of their source and
    the rule that moved them.
    """
    marks = anchors(events, approved, roles)
    joined = events.join(marks, "case_id", "left")
    here = F.struct(*[F.col(c) for c in ORDER])
    check, request = F.col("a_check"), F.col("a_request")
    micros = lambda h: (F.round(h * MICROS_HOUR)).cast("long")
    target = F.unix_micros("a_received.event_at") + micros(F.col("review_hours") + F.col("system_hours"))
    asked = target + micros(F.col("system_hours"))
    move_check = target - F.unix_micros("a_check.event_at")
    move_request = asked - F.unix_micros("a_request.event_at")
    is_check = F.coalesce(here == check, F.lit(False))
    is_request = F.coalesce(here == request, F.lit(False)) & ~is_check
    later = F.coalesce(here > request, F.lit(False)) & ~is_check
    recheck = later & (F.col("event_type") == roles.check)
    rule = (
        F.when(is_check, "structured_first_check")
        .when(is_request, "earlier_information_request")
        .when(later, "kept_interval_after_request")
    )
    system = is_check | recheck
    shift = F.when(is_check, move_check).when(is_request | later, move_request)
    changed = F.col("rule").isNotNull()
    own = [c for c in events.columns]
    return (
        joined.withColumns({"rule": rule, "shift_micros": shift, "_system": system})
        .withColumns(
            {
                "source_event_id": F.col("event_id"),
                "event_id": F.when(
                    changed, stable_id("sim-", 24, F.lit(run_id), F.col("event_id"), F.col("rule"))
                ).otherwise(F.col("event_id")),
                "external_event_id": F.when(
                    changed,
                    F.concat(
                        F.lit("SIM-"),
                        F.upper(F.substring(F.sha2(F.concat_ws(SEP, F.lit(run_id), F.col("event_id"), F.col("rule")), 256), 1, 24)),
                    ),
                ).otherwise(F.col("external_event_id")),
                "event_at": F.when(changed, plus_micros(F.col("event_at"), F.col("shift_micros"))).otherwise(
                    F.col("event_at")
                ),
                "actor_type": F.when(F.col("_system"), "system").otherwise(F.col("actor_type")),
                "actor_id": F.when(~F.col("_system"), F.col("actor_id")),
                "source_system": F.when(F.col("_system"), "admin_system").otherwise(
                    F.col("source_system")
                ),
                "channel": F.when(F.col("_system"), "internal_system").otherwise(F.col("channel")),
                "manual": ~F.col("_system") & F.col("manual"),
            }
        )
        .select(*own, "source_event_id", "rule", "shift_micros")
    )


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per rewritten event with the kinds of change."""
    old = before.select(
        F.col("event_id").alias("source_event_id"),
        F.col("event_at").alias("old_at"),
        F.col("manual").alias("old_manual"),
        F.col("actor_type").alias("old_actor_type"),
    )
    joined = after.where(F.col("rule").isNotNull()).join(old, "source_event_id")
    kinds = {
        "replaced": F.lit(True),
        "timestamp_shifted": F.col("event_at") != F.col("old_at"),
        "manual_marker_changed": F.col("manual") != F.col("old_manual"),
        "actor_type_changed": F.col("actor_type") != F.col("old_actor_type"),
    }
    return joined.select(
        "case_id",
        "source_event_id",
        "event_id",
        "rule",
        hours_between(F.col("old_at"), F.col("event_at")).alias("shift_hours"),
        violations(kinds).alias("changes"),
    )


def project_closed_at(cases: DataFrame, events: DataFrame, roles: Roles) -> DataFrame:
    """Refresh closed_at and updated_at from the first terminal event."""
    end = events.where(F.col("event_type").isin(*roles.terminal)).groupBy("case_id").agg(
        F.min(F.struct(*ORDER))["event_at"].alias("_end")
    )
    return (
        cases.join(end, "case_id", "left")
        .withColumns(
            {
                "closed_at": F.coalesce("_end", "closed_at"),
                "updated_at": F.when(
                    F.col("_end").isNotNull(), F.greatest("created_at", "_end")
                ).otherwise(F.col("updated_at")),
            }
        )
        .drop("_end")
    )


def symdiff_changed(changes: DataFrame, approved: DataFrame) -> DataFrame:
    """Cases on one side only: changed without approval or approved without change."""
    changed = changes.select("case_id").distinct().withColumn("_changed", F.lit(True))
    allowed = approved.select("case_id").distinct().withColumn("_approved", F.lit(True))
    return (
        changed.join(allowed, "case_id", "full_outer")
        .where(F.col("_changed").isNull() | F.col("_approved").isNull())
        .select(
            "case_id",
            F.when(F.col("_changed").isNull(), "approved_not_changed")
            .otherwise("changed_not_approved")
            .alias("problem"),
        )
    )


def overlay_validation(
    before: DataFrame,
    after: DataFrame,
    cases: DataFrame,
    changes: DataFrame,
    approved: DataFrame,
    scale: Scale,
) -> DataFrame:
    """(check, rows) for the altered log; 'source_rows_lost' compares with the untouched source."""
    one = F.count(F.lit(1))

    def total(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("rows")).select(
            F.lit(name).alias("check"), "rows"
        )

    ordered = scan(
        after, ["case_id"], ORDER, scale, previous={"prev_at": F.col("event_at")}
    )
    ids = after.groupBy("event_id").agg((one - 1).alias("_x"))
    lost = before.select(F.col("event_id").alias("source_event_id")).join(
        after.select("source_event_id"), "source_event_id", "left_anti"
    )
    parts = [
        total(orphan_events(after, cases), "orphan_events", one),
        total(after, "missing_times", F.count_if(F.col("event_at").isNull() | F.col("ingested_at").isNull())),
        total(ordered, "order_issues", F.count_if(F.col("event_at") < F.col("prev_at"))),
        total(
            after,
            "forbidden_metadata",
            F.count_if(F.coalesce(top_level_forbidden("metadata"), F.lit(False))),
        ),
        total(ids, "repeated_event_ids", F.sum("_x")),
        total(
            changes,
            "missing_provenance",
            F.count_if(F.col("source_event_id").isNull() | F.col("event_id").isNull()),
        ),
        total(symdiff_changed(changes, approved), "policy_change_mismatch", one),
        total(lost, "source_rows_lost", one),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def intervention_manifest(
    eligibility: DataFrame, approved: DataFrame, changes: DataFrame
) -> DataFrame:
    """(side, value, rows): decisions, refusal reasons, rules and change kinds."""
    decided = eligibility.join(
        approved.withColumn("_a", F.lit(True)), "case_id", "left"
    ).select(
        F.when(F.col("_a"), "approved")
        .when(F.col("eligible"), "not_selected")
        .otherwise("ineligible")
        .alias("value")
    )

    def spread(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(side).alias("side"), "value", "rows"
        )

    return (
        spread(decided, "decision")
        .unionByName(spread(eligibility.select(F.explode("reasons").alias("value")), "reason"))
        .unionByName(spread(changes.select(F.col("rule").alias("value")), "rule"))
        .unionByName(spread(changes.select(F.explode("changes").alias("value")), "change"))
    )


def compare_metrics(a: DataFrame, b: DataFrame, effects=None) -> DataFrame:
    """Two long cohort tables (dimension, value, metric, observed, sample): differences."""
    table = effects or EFFECTS
    effect = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    wanted = [*table, "first_pass_completeness_rate"]
    left = a.where(F.col("metric").isin(*wanted)).select(
        "dimension", "value", "metric", F.col("observed").alias("baseline")
    )
    right = b.where(F.col("metric").isin(*wanted)).select(
        "dimension", "value", "metric", F.col("observed").alias("simulated"), F.col("sample").alias("denominator")
    )
    diff = F.col("simulated") - F.col("baseline")
    # a cohort of one run only stays, without a difference
    return left.join(right, ["dimension", "value", "metric"], "full_outer").select(
        "dimension",
        "value",
        "metric",
        "baseline",
        "simulated",
        diff.alias("absolute_difference"),
        F.when(F.col("baseline") != 0, diff / F.col("baseline")).alias("relative_difference"),
        "denominator",
        F.when(diff.isNotNull(), "calculated").otherwise("unavailable").alias("status"),
        F.coalesce(effect[F.col("metric")], F.lit("unchanged")).alias("effect"),
    )


def run_summary(values: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row per cohort with the named metrics as columns."""
    return (
        values.where(F.col("metric").isin(*metrics))
        .groupBy("dimension", "value")
        .pivot("metric", list(metrics))
        .agg(F.max("observed"))
    )


def compare_process(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two (measure, number) tables side by side."""
    return a.withColumnRenamed("number", "baseline").join(
        b.withColumnRenamed("number", "simulated"), "measure", "full_outer"
    ).withColumn("absolute_difference", F.col("simulated") - F.col("baseline"))


def compare_burden(
    a: DataFrame,
    b: DataFrame,
    overhead: DataFrame,
    *,
    touch_minutes: float,
    cost_per_hour: float,
    upper_bound_hours: float | None = None,
) -> DataFrame:
    """Per cohort: hours and cost before, after, and of operating the intervention.

    a, b: (dimension, value, cases, metric, observed) cohort tables.
    overhead: (dimension, value, decision, touches) extra manual touches by decision.
    """
    per_touch = touch_minutes / 60

    def hours(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("metric") == "manual_touches").select(
            "dimension", "value", (F.coalesce("observed", F.lit(0.0)) * F.col("cases") * per_touch).alias(name)
        )

    def spent(*decisions: str) -> Column:
        return F.sum(F.when(F.col("decision").isin(*decisions), F.col("touches")).otherwise(0.0)) * per_touch

    operating = overhead.groupBy("dimension", "value").agg(
        spent("approved", "rejected").alias("review_hours"),
        spent("fallback", "failure").alias("fallback_hours"),
        spent("rolled_back").alias("recovery_hours"),
    )
    got = (
        hours(a, "baseline_hours")
        # a cohort of one run only counts with no hours in the other
        .join(hours(b, "simulated_hours"), ["dimension", "value"], "full_outer")
        .join(operating, ["dimension", "value"], "left")
        .na.fill(0.0)
        .withColumn("operating_hours", F.col("review_hours") + F.col("fallback_hours") + F.col("recovery_hours"))
        .withColumn("gross_hours", F.col("baseline_hours") - F.col("simulated_hours"))
        .withColumn("net_hours", F.col("gross_hours") - F.col("operating_hours"))
    )
    bound = F.lit(upper_bound_hours).cast("double")
    return got.withColumns(
        {
            "baseline_cost": F.col("baseline_hours") * cost_per_hour,
            "simulated_cost": F.col("simulated_hours") * cost_per_hour,
            "operating_cost": F.col("operating_hours") * cost_per_hour,
            "net_cost": F.col("net_hours") * cost_per_hour,
            "upper_bound_share": F.try_divide(F.col("net_hours"), bound),
        }
    )
