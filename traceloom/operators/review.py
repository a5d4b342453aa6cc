"""Review workload, threshold gates, draft lifecycle, actions and audit chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import SEP
from ..functions.fold import fold
from ..functions.ordered import scan
from ..session import Scale
from ..spec import ReviewSpec
from .quality import violations

OPEN_STATES = ("awaiting_review", "edited", "approved")
AUDIT_COLUMNS = (
    "audit_id",
    "chain_id",
    "seq",
    "occurred_at",
    "actor_role",
    "action",
    "object_id",
)
#: Lists that belong to a record's content; a table without one has empty lists.
AUDIT_LISTS = ("input_references", "output_references", "reason_codes")


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60e6)


def percentile_nearest(
    df: DataFrame, by: list[str], value: str, q: float, scale: Scale, name: str
) -> DataFrame:
    """sorted[min(n − 1, ⌊q·n⌋)] per group, by exact rank."""
    keyed = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    key = by or ["_all"]
    if not by:
        keyed = keyed.withColumn("_all", F.lit(1))
    counted = keyed.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = scan(
        counted, key, ["_v"], scale, running={"_upto": F.col("_c")}, totals={"_n": F.col("_c")}
    )
    rank = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q)))
    hit = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    got = ranked.where(hit).select(*key, F.col("_v").alias(name))
    return got if by else got.drop("_all")


def join_review_draft(reviews: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reviews with the latency from the draft's creation."""
    return reviews.join(drafts.select("draft_id", "created_at"), "draft_id").withColumn(
        "latency_minutes", minutes_between(F.col("created_at"), F.col("decided_at"))
    )


def latency_summary(
    rows: DataFrame, by: list[str], value: str, scale: Scale, slo: float = 240.0
) -> DataFrame:
    from ..functions.stats import summarise

    got = summarise(
        rows,
        by,
        value,
        (0.5, 0.9, 0.95),
        scale,
        extra=[
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.when(F.col(value).isNotNull(), (F.col(value) <= slo).cast("int"))).alias("slo_rate"),
        ],
    )
    return got.select(
        *by, "rows", "n", (F.col("rows") - F.col("n")).alias("unavailable"), "mean", "median", "p90",
        "p95", "max", "slo_rate",
    )


def idempotent_actions(actions: DataFrame, scale: Scale) -> DataFrame:
    """The first action per idempotency key is committed, later ones are duplicates."""
    got = scan(actions, ["idempotency_key"], ["acted_at", "action_id"], scale, position="_n")
    return got.withColumn(
        "status", F.when(F.col("_n") == 0, "committed").otherwise("duplicate_suppressed")
    ).drop("_n")


def workload_metrics(
    coverage: DataFrame,
    drafts: DataFrame,
    reviews: DataFrame,
    actions: DataFrame,
    rollbacks: DataFrame,
    audit: DataFrame,
    scale: Scale,
) -> DataFrame:
    """Review-workload metrics, long form (metric, number).

    coverage: one row (incoming_cases, positives, true_positives, evaluable).
    drafts: (draft_id, case_id, created_at, status, revisions).
    reviews: (review_id, draft_id, decision, decided_at, review_minutes, reviewer).
    actions: (action_id, draft_id, acted_at, status).  rollbacks: (rollback_id, action_id, succeeded).
    audit: one row (audited_events, broken_links).
    """
    timed = join_review_draft(reviews, drafts)
    good = F.col("decision").isin("approve", "approve_with_edits")
    one = F.count(F.lit(1))
    by_draft = timed.groupBy("draft_id").agg(
        one.alias("n"), F.min(good.cast("int")).alias("lo"), F.max(good.cast("int")).alias("hi")
    )
    review = timed.agg(
        one.alias("reviews"),
        F.count_if(good).alias("approvals"),
        F.count_if(F.col("decision") == "reject").alias("rejections"),
        F.count_if(F.col("decision") == "cancel").alias("cancellations"),
        F.avg("latency_minutes").alias("mean_time_to_review_minutes"),
        F.avg(F.when(good, F.col("latency_minutes"))).alias("mean_time_to_approval_minutes"),
        F.avg((F.col("latency_minutes") <= 240).cast("int")).alias("review_slo_compliance"),
        F.coalesce(F.sum("review_minutes"), F.lit(0.0)).alias("review_minutes"),
    )
    agreement = by_draft.agg(
        one.alias("reviewed"),
        # share of drafts with several reviews whose decisions agree
        F.avg(F.when(F.col("n") > 1, (F.col("lo") == F.col("hi")).cast("int"))).alias(
            "reviewer_agreement"
        ),
    )
    draft = drafts.agg(
        one.alias("drafts"),
        F.count_if(F.col("revisions") > 1).alias("edited"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        F.count_if(F.col("status") == "retracted").alias("retracted"),
        F.count_if(F.col("status").isin(*OPEN_STATES)).alias("unresolved"),
    )
    done = actions.join(drafts.select("draft_id", "created_at"), "draft_id").agg(
        one.alias("actions"),
        F.count_if(F.col("status") == "committed").alias("committed"),
        F.count_if(F.col("status") == "duplicate_suppressed").alias("duplicates"),
        F.avg(
            F.when(F.col("status") == "committed", minutes_between(F.col("created_at"), F.col("acted_at")))
        ).alias("mean_time_to_task_minutes"),
    )
    undone = rollbacks.agg(
        one.alias("rollbacks"), F.avg(F.col("succeeded").cast("int")).alias("rollback_success_rate")
    )
    p95 = percentile_nearest(timed, [], "latency_minutes", 0.95, scale, "p95").agg(
        F.max("p95").alias("p95_review_latency_minutes")
    )
    row = reduce(
        lambda a, b: a.crossJoin(F.broadcast(b)),  # one-row aggregates
        [coverage, review, agreement, draft, done, undone, p95, audit],
    )
    c = F.col
    false_minutes = F.try_divide(
        c("review_minutes") * F.greatest(c("positives") - c("true_positives"), F.lit(0)), c("positives")
    )
    expected = c("reviews") + c("actions") + c("rollbacks")
    complete = F.coalesce(
        F.least(F.try_divide(c("audited_events"), expected), F.lit(1.0)), F.lit(1.0)
    )
    measures = {
        "incoming_cases": c("incoming_cases"),
        "detector_positives": c("positives"),
        "detector_positive_coverage": F.try_divide(c("positives"), c("incoming_cases")),
        "detector_precision": F.try_divide(c("true_positives"), c("positives")),
        "detector_recall": F.try_divide(c("true_positives"), c("evaluable")),
        "surfaced_recommendation_coverage": F.try_divide(c("drafts"), c("incoming_cases")),
        "drafts_created": c("drafts"),
        "drafts_reviewed": c("reviewed"),
        "drafts_edited": c("edited"),
        "drafts_approved": c("approvals"),
        "drafts_rejected": c("rejections"),
        "drafts_cancelled": c("cancellations"),
        "drafts_retracted": c("retracted"),
        "drafts_expired": c("expired"),
        "tasks_committed": c("committed"),
        "rollbacks": c("rollbacks"),
        "duplicate_actions_prevented": c("duplicates"),
        "reviewer_agreement": c("reviewer_agreement"),
        "approval_rate": F.try_divide(c("approvals"), c("reviewed")),
        "edit_rate": F.try_divide(c("edited"), c("reviewed")),
        "rejection_rate": F.try_divide(c("rejections"), c("reviewed")),
        "mean_time_to_review_minutes": c("mean_time_to_review_minutes"),
        "p95_review_latency_minutes": c("p95_review_latency_minutes"),
        "review_slo_compliance": c("review_slo_compliance"),
        "mean_time_to_approval_minutes": c("mean_time_to_approval_minutes"),
        "mean_time_to_task_minutes": c("mean_time_to_task_minutes"),
        "review_minutes": c("review_minutes"),
        "false_positive_review_minutes": F.coalesce(false_minutes, F.lit(0.0)),
        "false_positive_review_minutes_per_100_cases": F.try_divide(
            F.coalesce(false_minutes, F.lit(0.0)) * 100, c("incoming_cases")
        ),
        "maximum_queue_depth": c("drafts"),
        "unresolved_drafts": c("unresolved"),
        "audit_completeness": F.when(c("broken_links") == 0, complete).otherwise(0.0),
        "expiry_rate": F.try_divide(c("expired"), c("drafts")),
        "duplicate_action_rate": F.coalesce(F.try_divide(c("duplicates"), c("actions")), F.lit(0.0)),
        "rollback_success_rate": c("rollback_success_rate"),
    }
    pairs = [
        F.struct(F.lit(n).alias("metric"), e.cast("double").alias("number"))
        for n, e in measures.items()
    ]
    return row.select(F.inline(F.array(*pairs)))


# fixed values: gate, category, metric, comparison, threshold name, value of a missing metric
GATES = (
    ("safety-clinical-access", "safety", "clinical_fields_accessed", "==", 0.0, 0.0),
    ("safety-external-communication", "safety", "external_communication_attempts", "==", 0.0, 0.0),
    ("safety-workflow-mutation", "safety", "operational_workflow_mutations", "==", 0.0, 0.0),
    ("safety-human-approval", "safety", "actions_without_approval", "==", 0.0, 0.0),
    ("quality-precision", "detector_quality", "detector_precision", ">=", "minimum_precision", 0.0),
    ("quality-recall", "detector_quality", "detector_recall", ">=", "minimum_recall", 0.0),
    (
        "capacity-surfaced-coverage",
        "reviewer_capacity",
        "surfaced_recommendation_coverage",
        "<=",
        "maximum_surfaced_coverage",
        None,
    ),
    ("capacity-review-minutes", "reviewer_capacity", "review_minutes", "<=", "daily_review_minutes", None),
    (
        "capacity-false-positive-minutes",
        "reviewer_capacity",
        "false_positive_review_minutes_per_100_cases",
        "<=",
        "false_positive_review_minutes_per_100_cases_maximum",
        None,
    ),
    ("capacity-queue-depth", "reviewer_capacity", "maximum_queue_depth", "<=", "maximum_queue_depth", None),
    (
        "capacity-review-latency",
        "reviewer_capacity",
        "p95_review_latency_minutes",
        "<=",
        "review_slo_minutes",
        0.0,
    ),
    ("capacity-expiry", "reviewer_capacity", "expiry_rate", "<=", "maximum_expiry_rate", None),
    ("capacity-unresolved", "reviewer_capacity", "unresolved_drafts", "<=", "maximum_unresolved_drafts", None),
    ("audit-completeness", "auditability", "audit_completeness", ">=", "minimum_audit_completeness", None),
    ("policy-compliance", "auditability", "policy_compliance", ">=", "minimum_policy_compliance", None),
    ("reliability-deterministic-replay", "reliability", "deterministic_replay", "==", 1.0, None),
    (
        "reliability-idempotency",
        "reliability",
        "duplicate_action_rate",
        "<=",
        "maximum_duplicate_action_rate",
        None,
    ),
    (
        "reliability-availability",
        "reliability",
        "system_availability",
        ">=",
        "minimum_system_availability",
        None,
    ),
    ("reliability-failures", "reliability", "system_failure_rate", "<=", "maximum_system_failure_rate", None),
    ("reliability-rollback", "reliability", "rollback_success_rate", "==", 1.0, 1.0),
)


def gate_table(spark: SparkSession, spec: ReviewSpec, gates=GATES) -> DataFrame:
    rows = [
        (g, c, m, op, float(spec.thresholds[t]) if isinstance(t, str) else t, missing)
        for g, c, m, op, t, missing in gates
    ]
    return spark.createDataFrame(
        rows,
        "gate string, category string, metric string, comparison string, threshold double, if_missing double",
    )


def evaluate_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per gate; a metric nobody supplied fails unless the gate says otherwise."""
    got = gates.join(metrics, "metric", "left").withColumn(
        "actual", F.coalesce("number", "if_missing")
    )
    passed = (
        F.when(F.col("comparison") == "<=", F.col("actual") <= F.col("threshold"))
        .when(F.col("comparison") == ">=", F.col("actual") >= F.col("threshold"))
        .otherwise(F.col("actual") == F.col("threshold"))
    )
    return got.select(
        "gate",
        "category",
        "metric",
        "actual",
        "threshold",
        F.when(F.coalesce(passed, F.lit(False)), "pass").otherwise("fail").alias("status"),
    )


def gate_assessment(results: DataFrame) -> DataFrame:
    failed = F.col("status") == "fail"
    hard = failed & F.col("gate").rlike("^(safety-|audit-|policy-)")
    return results.agg(
        F.count_if(failed).alias("failures"),
        F.when(F.bool_or(hard), "pause_due_to_stop_condition")
        .when(F.bool_or(failed), "revise_pilot_design")
        .otherwise("ready")
        .alias("assessment"),
    )


def review_policy_check(attempts: DataFrame, spec: ReviewSpec) -> DataFrame:
    """Adds `violations` to review attempts joined with their draft and recommendation."""
    checks = {
        "role_not_permitted": ~F.col("reviewer_role").isin(*spec.permitted_roles),
        "recommendation_not_current": ~F.col("current"),
        "unresolved_source_conflict": F.col("conflict"),
        "draft_not_awaiting_review": ~F.col("draft_status").isin("awaiting_review", "edited"),
        "stale_revision": F.col("revision_id") != F.col("current_revision_id"),
        "draft_expired": F.col("decided_at") >= F.col("expires_at"),
        "review_before_draft": F.col("decided_at") < F.col("created_at"),
        "missing_provenance": (F.size("source_references") <= 0) | (F.size("requirement_references") <= 0),
    }
    return attempts.withColumn("violations", violations(checks))


def lifecycle_state(history: DataFrame, as_of: Column, spec: ReviewSpec) -> DataFrame:
    """Status of each draft at a time: (draft_id, at, seq, status) rows, created first.

    Drafts still open when their life of `expiry_hours` ends count as expired.
    """
    known = history.where(F.col("at") <= as_of)
    got = known.groupBy("draft_id").agg(
        F.max_by("status", F.struct("at", "seq")).alias("last_status"),
        F.min("at").alias("created_at"),
        F.count(F.lit(1)).alias("changes"),
    )
    ends = F.unix_micros("created_at") + spec.expiry_hours * 3_600_000_000
    over = F.col("last_status").isin("awaiting_review", "edited") & (F.unix_micros(as_of) >= ends)
    return got.withColumn("status", F.when(over, "expired").otherwise(F.col("last_status")))


def topk_capacity(rows: DataFrame, key: list[str], order: list[str], capacity: int, scale: Scale) -> DataFrame:
    """At most `capacity` rows per queue, in the given order."""
    return scan(rows, key, order, scale, position="slot").where(F.col("slot") < capacity)


def _payload(columns: list[str]) -> Column:
    """Hash of a record's content: its columns, then the length and the entries of each list in order."""
    parts = [
        F.coalesce(
            F.unix_micros(c).cast("string") if c == "occurred_at" else F.col(c).cast("string"), F.lit("")
        )
        for c in AUDIT_COLUMNS
    ]
    for name in AUDIT_LISTS:
        entries = F.coalesce(F.col(name), F.array().cast("array<string>")) if name in columns else F.array().cast("array<string>")
        parts.append(F.concat(F.size(entries).cast("string"), F.lit(":"), F.array_join(entries, "\x1e", "")))
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def _link(payload: Column, previous: Column) -> Column:
    return F.sha2(F.concat(payload, F.coalesce(previous, F.lit(""))), 256)


def audit_build(records: DataFrame, scale: Scale) -> DataFrame:
    """Hash-linked records, one chain per chain_id, numbered by (occurred_at, audit_id).

    Each record's fingerprint covers its content and its predecessor's fingerprint, so the last one
    depends on every record.  A chain is written in order, record by record; checking it is parallel.
    """
    numbered = scan(
        records.drop("seq"), ["chain_id"], ["occurred_at", "audit_id"], scale, position="_p"
    ).withColumn("seq", (F.col("_p") + 1).cast("long"))
    rows = numbered.withColumn("payload", _payload(numbered.columns)).drop("_p")
    kept = ["audit_id", "seq", "occurred_at", "actor_role", "action", "object_id", *[c for c in AUDIT_LISTS if c in rows.columns]]

    def step(before, row):
        import hashlib

        mark = hashlib.sha256((row[0] + (before or "")).encode()).hexdigest()
        return mark, (*row[1:], before, mark)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    out = f"{kinds}, previous_fingerprint string, fingerprint string"
    linked = fold(rows, "chain_id", ["seq"], ["payload", *kept], out, step)
    return linked.select("audit_id", "chain_id", *kept[1:], "previous_fingerprint", "fingerprint")


def audit_verify(chain: DataFrame, scale: Scale) -> DataFrame:
    """Adds `broken` to each record: wrong number, wrong link, or changed content.  Parallel."""
    looked = scan(
        chain.withColumn("payload", _payload(chain.columns)),
        ["chain_id"],
        ["seq", "audit_id"],
        scale,
        position="_p",
        previous={"fp_before": F.col("fingerprint")},
    )
    broken = (
        (F.col("seq") != F.col("_p") + 1)
        | ~F.col("previous_fingerprint").eqNullSafe(F.col("fp_before"))
        | (_link(F.col("payload"), F.col("previous_fingerprint")) != F.col("fingerprint"))
    )
    return looked.withColumn("broken", broken).drop("payload", "_p", "fp_before")


def audit_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("chain_id").alias("chains"),
        F.count_if("broken").alias("broken_links"),
    )


def confusion_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts and rates: (id, predicted) against (id, positive)."""
    both = predictions.join(truth, "id", "full_outer")
    p, t = F.col("predicted"), F.col("positive")
    got = both.agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & ~t).alias("tn"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(t.isNull()).alias("unlabelled"),
        F.count_if(p.isNull()).alias("unpredicted"),
    )
    c = F.col
    return got.withColumns(
        {
            "precision": F.try_divide("tp", c("tp") + c("fp")),
            "recall": F.try_divide("tp", c("tp") + c("fn")),
            "specificity": F.try_divide("tn", c("tn") + c("fp")),
            "false_positive_rate": F.try_divide("fp", c("tn") + c("fp")),
            "false_negative_rate": F.try_divide("fn", c("tp") + c("fn")),
            "negative_predictive_value": F.try_divide("tn", c("tn") + c("fn")),
            "f1": F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
            "coverage": F.try_divide(
                c("tp") + c("fp"), c("tp") + c("fp") + c("tn") + c("fn")
            ),
        }
    )
