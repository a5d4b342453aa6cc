"""Intake snapshots, label intervals and review records read out of the `events` table.

All are row-wise projections, so they work on a batch and on a stream alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import scan
from ..session import Scale
from ..spec import ContractSpec
from .tables import pick, table, table_scale

FIELD = "array<struct<field_id:string,state:string,applicable:boolean,observed_at:timestamp,producer_system:string,provenance_references:array<string>>>"
SNAPSHOT_SCHEMA = (
    "snapshot_id string, case_id string, available_at timestamp, source_event_at timestamp, "
    "source_system string, source_record_identifier string, source_record_version int, "
    f"form_identifier string, form_version string, requirements_contract_version string, fields {FIELD}, "
    "source_warning_codes array<string>, manual_review_state string, freshness string, "
    "conflict_status string, update_type string, superseded_snapshot_id string, "
    "producer_system string, provenance_references array<string>, declaration string, "
    "schema_version int"
)
FORM_SCHEMA = (
    "form_no int, form_identifier string, form_version string, effective_from timestamp, "
    "effective_until timestamp, unsupported_sources array<string>"
)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def document_state(raw: Column, k: Column) -> Column:
    return (
        F.when(raw == "purchase", "present")
        .when(raw == "view", F.when(k < 40, "present").otherwise("absent"))
        .when(raw == "click", F.when(k < 50, "pending_source_update").otherwise("verification_required"))
        .when(raw == "signup", F.when(k < 30, "unknown").when(k < 60, "not_applicable").otherwise("absent"))
        .otherwise(
            F.when(k < 20, "conflicting").when(k < 40, "stale").when(k < 60, "unsupported").otherwise("absent")
        )
    )


def snapshot_id(event_id: Column) -> Column:
    """Event 24 of every 25 repeats the identifier of the event before it."""
    number = F.when(F.pmod(event_id, F.lit(25)) == 24, event_id - 1).otherwise(event_id)
    return F.concat(F.lit("S"), F.lpad(number.cast("string"), 12, "0"))


def snapshots(events: DataFrame, spec: ContractSpec = ContractSpec()) -> DataFrame:
    """One snapshot per event of the raw `events` table (batch or stream)."""
    e = events.withColumn("k", _k())
    k, ts = F.col("k"), F.col("ts")

    def mod(n: int) -> Column:
        return F.pmod(k, F.lit(n))

    state = document_state(F.col("event_type"), k)
    none = F.array().cast("array<string>")
    prov = F.when(mod(5) == 4, none).otherwise(F.array(F.lit("intake-log")))
    producer = F.when(mod(16) == 15, F.lit(" ")).otherwise(
        F.concat(F.lit("producer-"), mod(3).cast("string"))
    )

    def field(name: Column, value: Column, applies: Column) -> Column:
        return F.struct(
            name.alias("field_id"),
            value.alias("state"),
            applies.alias("applicable"),
            ts.alias("observed_at"),
            producer.alias("producer_system"),
            prov.alias("provenance_references"),
        )

    applies = F.when(mod(15) != 14, (state != "not_applicable") | (mod(6) == 0))
    base = F.array(
        field(F.lit("supporting_document"), state, applies),
        field(F.lit("referral_form"), F.lit("present"), F.lit(True)),
    )
    extra = F.array(field(F.lit("extra_field"), F.lit("unknown"), F.lit(None).cast("boolean")))
    update = pick(k, ("retry", "supersession", "correction", "initial", "initial", "initial", "initial"))
    return e.select(
        snapshot_id(F.col("event_id")).alias("snapshot_id"),
        F.col("user_id").cast("string").alias("case_id"),
        ts.alias("available_at"),
        F.timestamp_micros(
            F.unix_micros(ts)
            + F.when(mod(10) == 0, F.lit(5)).otherwise(-k).cast("long") * 60_000_000
        ).alias("source_event_at"),
        pick(k, ("referral_portal", "secure_email", "manual_entry", "admin_system")).alias("source_system"),
        F.concat_ws("-", F.concat(F.lit("R"), F.col("user_id").cast("string")), mod(5).cast("string")).alias(
            "source_record_identifier"
        ),
        (mod(3) + 1).cast("int").alias("source_record_version"),
        F.lit("intake").alias("form_identifier"),
        F.when(mod(10) < 5, "INTAKE-2").when(mod(10) < 9, "INTAKE-1").otherwise("INTAKE-9").alias("form_version"),
        F.when(mod(12) == 11, "requirements-v1")
        .otherwise(spec.contract_version)
        .alias("requirements_contract_version"),
        F.when(mod(30) == 29, F.concat(base, extra)).otherwise(base).alias("fields"),
        F.when(mod(8) == 7, F.array(F.lit(spec.missing_warning))).otherwise(none).alias("source_warning_codes"),
        F.when(mod(9) == 0, "started")
        .when(mod(9) == 1, "completed")
        .when(mod(9) == 2, "unavailable")
        .otherwise("not_started")
        .alias("manual_review_state"),
        F.when(mod(11) == 10, "stale").when(mod(13) == 12, "unknown").otherwise("fresh").alias("freshness"),
        F.when(mod(14) == 13, "detected").otherwise("none").alias("conflict_status"),
        update.alias("update_type"),
        F.when((update == "supersession") & (mod(4) != 3), snapshot_id(F.col("event_id") - 1)).alias(
            "superseded_snapshot_id"
        ),
        producer.alias("producer_system"),
        prov.alias("provenance_references"),
        F.when(mod(18) == 17, "other").otherwise(spec.declaration).alias("declaration"),
        F.lit(2).alias("schema_version"),
    )


def snapshots_v1(events: DataFrame) -> DataFrame:
    """The same arrivals in the older shape: presence states in fixed columns."""
    k = _k()
    return events.select(
        snapshot_id(F.col("event_id")).alias("snapshot_id"),
        F.col("user_id").cast("string").alias("case_id"),
        F.col("ts").alias("available_at"),
        pick(k, ("referral_portal", "secure_email", "manual_entry", "admin_system")).alias("source_system"),
        F.lit("INTAKE-1").alias("form_version"),
        pick(k, ("present", "absent", "unknown")).alias("supporting_document"),
        F.lit(1).alias("schema_version"),
    )


def label_intervals(events: DataFrame) -> DataFrame:
    """(label_id, case_id, valid_from, valid_until, status) from the signup events."""
    k, day = _k(), 86_400_000_000
    start = F.unix_micros("ts") - 5 * day
    return events.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("L"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("label_id"),
        F.col("user_id").cast("string").alias("case_id"),
        F.timestamp_micros(start).alias("valid_from"),
        F.when(k < 80, F.timestamp_micros(start + 10 * day)).alias("valid_until"),
        F.when(F.pmod(k, F.lit(3)) != 0, "positive").otherwise("negative").alias("status"),
    )


def contract_forms(spark: SparkSession) -> DataFrame:
    """A small requirements contract: three dated declarations of two form versions."""
    rows = [
        (0, "intake", "INTAKE-2", datetime(2024, 1, 5), None, ["manual_entry"]),
        (1, "intake", "INTAKE-2", datetime(2024, 1, 1), datetime(2024, 1, 10), []),
        (2, "intake", "INTAKE-1", datetime(2024, 1, 1), None, ["secure_email"]),
    ]
    return spark.createDataFrame(rows, FORM_SCHEMA)


def contract_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (form, name, field, required, when_field, equals)
        for form in (0, 1, 2)
        for name, field, required, when_field, equals in (
            ("intake-form", "referral_form", True, None, None),
            ("document", "supporting_document", True, None, None),
            ("contact", "routing_contact", True, "supporting_document", "present"),
            ("note", "source_acknowledgement", False, None, None),
        )
    ]
    return spark.createDataFrame(
        rows,
        "form_no int, requirement_id string, field_id string, required boolean, "
        "condition_field string, condition_equals string",
    )


def review_records(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], Scale]:
    """Drafts, reviews, actions and rollbacks: each refers to the user's latest one before it.

    view → draft, click → review of the last draft, purchase → action on it,
    error with k < 20 → rollback of the last action.
    """
    scale = table_scale(spark, folder, "events")
    kind = F.col("event_type")
    rows = table(spark, folder, "events").withColumn("k", _k())
    ident = F.lpad(F.col("event_id").cast("string"), 12, "0")
    linked = scan(
        rows.withColumn("ident", ident),
        ["user_id"],
        ["ts", "event_id"],
        scale,
        carry={
            "draft_id": F.when(kind == "view", F.col("ident")),
            "draft_at": F.when(kind == "view", F.col("ts")),
            "draft_k": F.when(kind == "view", F.col("k")),
            "review_id": F.when(kind == "click", F.col("ident")),
            "action_id": F.when(kind == "purchase", F.col("ident")),
        },
    )
    k = F.col("k")
    drafts = linked.where(kind == "view").select(
        "draft_id",
        F.col("user_id").cast("string").alias("case_id"),
        F.col("ts").alias("created_at"),
        (F.pmod(k, F.lit(2)) + 1).alias("revisions"),
        (F.pmod(k, F.lit(17)) != 0).alias("current"),
        (F.pmod(k, F.lit(19)) == 0).alias("conflict"),
    )
    reviews = linked.where((kind == "click") & F.col("draft_id").isNotNull()).select(
        F.col("ident").alias("review_id"),
        "draft_id",
        F.col("draft_at").alias("created_at"),
        "draft_k",
        pick(k, ("approve", "approve_with_edits", "reject", "cancel", "approve")).alias("decision"),
        F.col("ts").alias("decided_at"),
        F.col("value").alias("review_minutes"),
        pick(k, ("admin_reviewer", "pilot_supervisor", "visitor")).alias("reviewer_role"),
        k.alias("k"),
    )
    actions = linked.where((kind == "purchase") & F.col("draft_id").isNotNull()).select(
        F.col("ident").alias("action_id"),
        "draft_id",
        "review_id",
        F.col("draft_id").alias("idempotency_key"),
        F.col("ts").alias("acted_at"),
    )
    rollbacks = linked.where(
        (kind == "error") & (k < 20) & F.col("action_id").isNotNull()
    ).select(
        F.col("ident").alias("rollback_id"),
        "action_id",
        "draft_id",
        F.col("ts").alias("rolled_back_at"),
        (F.pmod(k, F.lit(5)) != 0).alias("succeeded"),
    )
    return {"drafts": drafts, "reviews": reviews, "actions": actions, "rollbacks": rollbacks}, scale


def draft_history(parts: dict[str, DataFrame]) -> DataFrame:
    """(draft_id, at, seq, status): every status change of every draft."""
    decided = {
        "approve": "approved",
        "approve_with_edits": "edited",
        "reject": "rejected",
        "cancel": "cancelled",
    }
    new_status = F.create_map(*[x for a, b in decided.items() for x in (F.lit(a), F.lit(b))])
    created = parts["drafts"].select(
        "draft_id", F.col("created_at").alias("at"), F.lit(0).alias("seq"), F.lit("awaiting_review").alias("status")
    )
    reviewed = parts["reviews"].select(
        "draft_id", F.col("decided_at").alias("at"), F.lit(1).alias("seq"),
        new_status[F.col("decision")].alias("status"),
    )
    acted = parts["actions"].select(
        "draft_id", F.col("acted_at").alias("at"), F.lit(2).alias("seq"), F.lit("committed").alias("status")
    )
    undone = parts["rollbacks"].select(
        "draft_id", F.col("rolled_back_at").alias("at"), F.lit(3).alias("seq"), F.lit("rolled_back").alias("status")
    )
    return created.unionByName(reviewed).unionByName(acted).unionByName(undone)


def audit_records(spark: SparkSession, folder: str) -> tuple[DataFrame, Scale]:
    """One audit record per click, purchase and error; one chain per user."""
    scale = table_scale(spark, folder, "events")
    e = table(spark, folder, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    action = F.create_map(
        F.lit("click"), F.lit("draft_review"), F.lit("purchase"), F.lit("committed_task"),
        F.lit("error"), F.lit("rollback_task"),
    )
    none = F.array().cast("array<string>")
    return (
        e.select(
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("audit_id"),
            F.col("user_id").cast("string").alias("chain_id"),
            F.lit(0).cast("long").alias("seq"),
            F.col("ts").alias("occurred_at"),
            F.lit("admin_reviewer").alias("actor_role"),
            action[F.col("event_type")].alias("action"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("object_id"),
            F.array(F.concat(F.lit("case-"), F.col("user_id").cast("string")), snapshot_id(F.col("event_id"))).alias("input_references"),
            F.when(F.col("event_type") == "purchase", F.array(F.concat(F.lit("task-"), F.col("event_id").cast("string"))))
            .otherwise(none)
            .alias("output_references"),
            F.when(F.pmod(_k(), F.lit(4)) == 0, F.array(F.lit("late"), F.lit("checked")))
            .when(F.pmod(_k(), F.lit(4)) == 1, F.array(F.lit("late")))
            .otherwise(none)
            .alias("reason_codes"),
        ),
        scale,
    )


def research_observations(spark: SparkSession, folder: str, archetypes: tuple[str, ...]) -> DataFrame:
    """Conversation turns read as research observations of one session per conversation."""
    turns = table(spark, folder, "conversations").where(F.col("role") != "system")
    turn, conv = F.col("turn"), F.col("conv_id")
    ident = F.concat_ws("-", F.lit("OBS"), conv.cast("string"), turn.cast("string"))
    cohort = F.pmod(turn, F.lit(3)) == 1
    none = F.array().cast("array<string>")
    return turns.select(
        F.concat(F.lit("SESSION-"), conv.cast("string")).alias("session_id"),
        F.concat(F.lit("P-"), conv.cast("string")).alias("participant_id"),
        F.col("role").alias("session_role"),
        ident.alias("observation_id"),
        F.col("role").alias("affected_role"),
        F.when(cohort, "service_line").alias("cohort_dimension"),
        F.when(
            cohort, pick(conv, ("cardiology", "dermatology", "musculoskeletal", "neurology", "respiratory"))
        ).alias("cohort_value"),
        F.concat(F.lit("problem-"), F.pmod(F.length("text"), F.lit(7)).cast("string")).alias("reported_problem"),
        pick(turn, ("low", "moderate", "high")).alias("severity"),
        F.array(pick(conv + turn, archetypes)).alias("supported_archetypes"),
        F.when(
            (turn > 1) & (F.pmod(turn, F.lit(4)) == 2),
            F.array(F.concat_ws("-", F.lit("OBS"), conv.cast("string"), (turn - 1).cast("string"))),
        )
        .otherwise(none)
        .alias("contradicts"),
    )
