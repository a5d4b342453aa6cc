"""Intake snapshots: contract validation, contradictions, quality and observability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.calendar import plus_micros
from ..functions.ordered import scan
from ..functions.stats import first_ids
from ..session import Scale, pin
from ..spec import ContractSpec

SNAPSHOT_ORDER = ["available_at", "snapshot_id"]
ERROR_CODES = (
    "duplicate_snapshot",
    "absent_producer",
    "invalid_supersession",
    "missing_declaration",
    "unsupported_field_identifier",
    "impossible_field_state",
    "unknown_superseded_snapshot",
)


def field_of(name: str) -> Column:
    """The first observation of a field inside the snapshot's array (null when absent)."""
    return F.get(F.filter("fields", lambda f: f["field_id"] == name), F.lit(0))


def with_document(snapshots: DataFrame, spec: ContractSpec) -> DataFrame:
    """Add the document field's state and applicability as columns."""
    return snapshots.withColumn("_doc", field_of(spec.document_field)).withColumns(
        {"doc_state": F.col("_doc.state"), "doc_applicable": F.col("_doc.applicable")}
    ).drop("_doc")


def effective_form(snapshots: DataFrame, forms: DataFrame) -> DataFrame:
    """Effective-dated join: adds form_no of the first declared form valid at arrival.

    forms: (form_no, form_identifier, form_version, effective_from,
    effective_until, unsupported_sources array), a small contract table.
    """
    # (form, version) pairs carry their declarations in an array: the join stays an
    # equi join and yields one row per snapshot, the first match is taken inside it
    listed = forms.groupBy("form_identifier", "form_version").agg(
        F.array_sort(
            F.collect_list(
                F.struct("form_no", "effective_from", "effective_until", "unsupported_sources")
            )
        ).alias("_forms")
    )
    valid = F.filter(
        "_forms",
        lambda f: (f["effective_from"] <= F.col("available_at"))
        & (f["effective_until"].isNull() | (F.col("available_at") < f["effective_until"]))
        & ~F.array_contains(f["unsupported_sources"], F.col("source_system")),
    )
    return (
        snapshots.join(listed, ["form_identifier", "form_version"], "left")
        .withColumn("form_no", F.get(valid, F.lit(0))["form_no"])
        .drop("_forms")
    )


def required_rules(snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """Required rules of each snapshot's form whose condition holds for its field values.

    rules: (form_no, requirement_id, field_id, required, condition_field, condition_equals).
    """
    values = F.map_from_entries(
        F.transform(
            F.filter("fields", lambda f: f["field_id"].isNotNull()),
            lambda f: F.struct(f["field_id"], f["state"]),
        )
    )
    applies = F.col("condition_field").isNull() | (
        F.try_element_at(F.col("_values"), F.col("condition_field")) == F.col("condition_equals")
    )
    return (
        snapshots.withColumn("_values", values)
        .join(rules.where(F.col("required")), "form_no")
        .where(applies)
        .select("snapshot_id", "form_no", "requirement_id", "field_id")
    )


_OPEN = "array<struct<until:bigint,status:string>>"


def _merged(earlier: Column, later: Column) -> Column:
    """Open intervals of two stretches of time: those of the earlier one that outlast all of the later one stay below.

    Both are in order of their start, each ending before the one under it, so an interval that a
    later one outlasts is gone: it can never be the last one open again.
    """
    top = F.get(later, F.lit(0))["until"]
    outlasts = lambda x: x["until"].isNull() | (top.isNotNull() & (x["until"] > top))
    return F.when(F.size(later) == 0, earlier).otherwise(F.concat(F.filter(earlier, outlasts), later))


def _folded(stacks: Column) -> Column:
    return F.aggregate(stacks, F.array().cast(_OPEN), _merged)


def _before(chunks: DataFrame, most: int, fan: int) -> DataFrame:
    """(case_id, n, before): what is open when a chunk begins, from (case_id, n, stack), most being the largest n.

    Chunks combine in groups of `fan`, groups in groups again, so nobody holds all chunks of a case.
    """
    group = F.floor(F.col("n") / fan).cast("long")
    earlier = Window.partitionBy("case_id", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("g", group).withColumn("before", _folded(F.collect_list("stack").over(earlier)))
    if most < fan:
        return rows.select("case_id", "n", "before")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("n", "stack"))), lambda x: x["stack"])
    groups = rows.groupBy("case_id", "g").agg(_folded(whole).alias("stack")).withColumnRenamed("g", "n")
    outer = _before(groups, most // fan, fan).select("case_id", F.col("n").alias("g"), F.col("before").alias("outer"))
    return rows.join(outer, ["case_id", "g"]).select("case_id", "n", _merged(F.col("outer"), F.col("before")).alias("before"))


def asof_label(facts: DataFrame, labels: DataFrame, scale: Scale | None = None, chunk: int = 256, fan: int = 64) -> DataFrame:
    """Label valid at each fact's time: (case_id, as_of) plus `label`.

    The last interval by (valid_from, label_id) wins; no interval gives
    'not_evaluable'.  Intervals and facts of a case are cut into chunks of consecutive rows; a chunk
    passes on the intervals that are open and not yet outlasted, and a fact looks at those of the
    chunks before its own and at its own chunk.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none = F.lit(None)
    opened = labels.where("valid_from is not null").select(
        "case_id", micros("valid_from").alias("at"), F.lit(0).alias("kind"),
        F.col("label_id").cast("string").alias("label_id"), F.col("status"), micros("valid_until").alias("until"),
    )
    asked = facts.where("as_of is not null").select(
        "case_id", micros("as_of").alias("at"), F.lit(1).alias("kind"),
        none.cast("string").alias("label_id"), none.cast("string").alias("status"), none.cast("long").alias("until"),
    ).distinct()
    rows = opened.unionByName(asked)
    if scale is None:
        rows = pin(rows)
        scale = Scale.of(rows, "case_id")
    most = scale.bound("case_id")
    order = ["at", "kind", "label_id", "until", "status"]
    placed = scan(rows, ["case_id"], order, scale, position="pos").withColumn("n", F.floor(F.col("pos") / chunk).cast("long"))
    listed = F.sort_array(F.collect_list(F.struct("pos", "at", "kind", "until", "status")))
    chunks = placed.groupBy("case_id", "n").agg(listed.alias("rows"))
    starts = F.filter("rows", lambda r: r["kind"] == 0)
    one = lambda r: F.array(F.struct(r["until"].alias("until"), r["status"].alias("status")))
    stack = F.aggregate(starts, F.array().cast(_OPEN), lambda a, r: _merged(a, one(r)))
    chunks = chunks.withColumn("stack", stack)
    if most > chunk:
        chunks = pin(chunks)
        state = _before(chunks.select("case_id", "n", "stack"), most // chunk, fan)
        chunks = chunks.join(state, ["case_id", "n"])
    else:
        chunks = chunks.withColumn("before", F.array().cast(_OPEN))

    def answer(f: Column) -> Column:
        running = lambda r: r["until"].isNull() | (r["until"] > f["at"])
        own = F.filter("rows", lambda r: (r["kind"] == 0) & (r["pos"] < f["pos"]) & running(r))
        old = F.filter("before", running)
        status = F.when(F.size(own) > 0, F.try_element_at(own, F.lit(-1))["status"]).otherwise(F.try_element_at(old, F.lit(-1))["status"])
        return F.struct(f["at"].alias("at"), status.alias("label"))

    hit = chunks.select("case_id", F.inline(F.transform(F.filter("rows", lambda r: r["kind"] == 1), answer)))
    hit = hit.withColumn("as_of", F.timestamp_micros("at").cast(facts.schema["as_of"].dataType)).drop("at")
    return facts.join(hit, ["case_id", "as_of"], "left").withColumn(
        "label", F.coalesce("label", F.lit("not_evaluable"))
    )


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*key, "_r.*")


def usable(spec: ContractSpec) -> Column:
    """Fresh and without a detected conflict."""
    return (F.col("freshness") == "fresh") & (F.col("conflict_status") != "detected")


def source_rank(spec: ContractSpec, source: Column) -> Column:
    """0-based place in the priority list; unknown sources come after all others."""
    spot = F.array_position(F.array(*[F.lit(p) for p in spec.priority]), source)
    return F.when(spot > 0, spot - 1).otherwise(F.lit(len(spec.priority)))


def precedence(snapshots: DataFrame, spec: ContractSpec) -> DataFrame:
    return snapshots.withColumns(
        {"usable": usable(spec), "source_rank": source_rank(spec, F.col("source_system"))}
    )


def state_semantics(spark: SparkSession, states=None) -> DataFrame:
    return spark.createDataFrame(
        [(s, *flags) for s, flags in (states or vocab.FIELD_STATES).items()],
        "state string, recommendation_permitted boolean, abstention_required boolean, "
        "confirmation_appropriate boolean, retry_expected boolean, "
        "suppress_duplicate_warning boolean, resolved boolean",
    )


def snapshot_view(v1: DataFrame, v2: DataFrame, spec: ContractSpec) -> DataFrame:
    """Both snapshot versions in one table; what version 1 does not know stays null."""
    common = ["case_id", "snapshot_id", "schema_version", "available_at", "source_system", "form_version"]
    old = v1.select(*common, F.col("supporting_document").alias("document_state"))
    new = with_document(v2, spec).select(
        *common,
        F.coalesce("doc_state", F.lit("unsupported")).alias("document_state"),
        "requirements_contract_version",
    )
    return old.unionByName(new, allowMissingColumns=True)


def contradictions(snapshots: DataFrame, spec: ContractSpec, scale: Scale) -> DataFrame:
    """(type, case_id, first_id, second_id) of five kinds of contradicting snapshots."""
    warned = F.array_contains("source_warning_codes", spec.missing_warning)
    resolved = (F.col("doc_state") == "present") & (F.col("conflict_status") == "none")
    rows = with_document(snapshots, spec)
    ordered = scan(
        rows.select(
            "case_id", "snapshot_id", "available_at", "source_record_version", "doc_state",
            "conflict_status", "source_warning_codes",
        ),
        ["case_id"],
        SNAPSHOT_ORDER,
        scale,
        previous={
            "prev_id": F.col("snapshot_id"),
            "prev_version": F.col("source_record_version"),
        },
        carry={"resolved_upto": F.when(resolved, F.col("snapshot_id"))},
    )
    ordered = scan(
        ordered, ["case_id"], SNAPSHOT_ORDER, scale, previous={"resolved_id": F.col("resolved_upto")}
    )
    producers = latest_per_key(
        rows.select("case_id", "producer_system", "snapshot_id", "available_at", "doc_state"),
        ["case_id", "producer_system"],
        SNAPSHOT_ORDER,
    )
    none = F.lit(None).cast("string")

    def kind(df: DataFrame, name: str, first: Column, second: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("type"), "case_id", first.alias("first_id"), second.alias("second_id")
        )

    pairs = producer_pairs(producers)
    parts = [
        kind(
            rows.where((F.col("doc_state") == "not_applicable") & warned),
            "not_applicable_with_missing_warning",
            F.col("snapshot_id"),
            none,
        ),
        kind(
            rows.where(
                (F.col("manual_review_state") == "completed")
                & (F.col("source_event_at") > F.col("available_at"))
            ),
            "review_complete_before_availability",
            F.col("snapshot_id"),
            none,
        ),
        kind(
            ordered.where(F.col("source_record_version") < F.col("prev_version")),
            "non_monotonic_supersession",
            F.col("prev_id"),
            F.col("snapshot_id"),
        ),
        kind(
            ordered.where(F.col("resolved_id").isNotNull() & warned),
            "warning_after_resolution",
            F.col("resolved_id"),
            F.col("snapshot_id"),
        ),
        kind(pairs, "producer_disagreement", F.col("left_id"), F.col("right_id")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def producer_pairs(producers: DataFrame) -> DataFrame:
    """Producer pairs of a case whose latest document states differ.

    The input has one row per (case, producer); a case has as many rows as it has
    producing systems.
    """
    known = producers.where(F.col("doc_state").isNotNull())
    left = known.select(
        "case_id",
        F.col("producer_system").alias("left_producer"),
        F.col("snapshot_id").alias("left_id"),
        F.col("doc_state").alias("left_state"),
    )
    right = known.select(
        "case_id",
        F.col("producer_system").alias("right_producer"),
        F.col("snapshot_id").alias("right_id"),
        F.col("doc_state").alias("right_state"),
    )
    return left.join(right, "case_id").where(
        (F.col("left_producer") < F.col("right_producer"))
        & (F.col("left_state") != F.col("right_state"))
    )


def contradiction_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("contradictions"))


def snapshot_findings(
    snapshots: DataFrame, forms: DataFrame, spec: ContractSpec, scale: Scale
) -> DataFrame:
    """(code, snapshot_id, arrival): one row per broken rule and snapshot."""
    dated = effective_form(snapshots, forms)
    dup = scan(dated, ["snapshot_id"], ["available_at"], scale, position="_copy")
    banned = F.size(
        F.filter("fields", lambda f: ~f["field_id"].isin(*spec.allowed_fields))
    )
    impossible = F.size(
        F.filter(
            "fields", lambda f: (f["state"] == "not_applicable") & f["applicable"]
        )
    )
    codes = {
        "duplicate_snapshot": F.when(F.col("_copy") > 0, 1),
        "unsupported_form_contract": F.when(F.col("form_no").isNull(), 1),
        "requirements_version_mismatch": F.when(
            F.col("requirements_contract_version") != spec.contract_version, 1
        ),
        "absent_producer": F.when(F.trim("producer_system") == "", 1),
        "invalid_supersession": F.when(
            (F.col("update_type") == "supersession") & F.col("superseded_snapshot_id").isNull(), 1
        ),
        "missing_declaration": F.when(F.col("declaration") != spec.declaration, 1),
        "unsupported_field_identifier": banned,
        "impossible_field_state": impossible,
    }
    entries = [
        F.struct(F.lit(c).alias("code"), F.coalesce(n, F.lit(0)).cast("long").alias("hits"))
        for c, n in codes.items()
    ]
    each = dup.select("snapshot_id", "available_at", F.inline(F.array(*entries))).where(
        F.col("hits") > 0
    )
    ordered = scan(
        snapshots.select(
            "case_id", "snapshot_id", "available_at", "source_record_version", "superseded_snapshot_id"
        ),
        ["case_id"],
        SNAPSHOT_ORDER,
        scale,
        previous={"prev_version": F.col("source_record_version")},
    )
    late = ordered.where(F.col("source_record_version") < F.col("prev_version"))
    ids = snapshots.select("case_id", F.col("snapshot_id").alias("superseded_snapshot_id"))
    lost = ordered.where(F.col("superseded_snapshot_id").isNotNull()).join(
        ids, ["case_id", "superseded_snapshot_id"], "left_anti"
    )

    def coded(df: DataFrame, code: str) -> DataFrame:
        return df.select(
            "snapshot_id", "available_at", F.lit(code).alias("code"), F.lit(1).cast("long").alias("hits")
        )

    return each.unionByName(coded(late, "out_of_order_source_version")).unionByName(
        coded(lost, "unknown_superseded_snapshot")
    )


def snapshot_validation(found: DataFrame, contradicting: DataFrame) -> DataFrame:
    """(code, severity, occurrences) including the contradictions."""
    counted = found.groupBy("code").agg(F.sum("hits").alias("occurrences"))
    clash = (
        contradicting.agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 0)
        .select(F.lit("source_contradiction").alias("code"), "occurrences")
    )
    return counted.unionByName(clash).withColumn(
        "severity", F.when(F.col("code").isin(*ERROR_CODES), "error").otherwise("warning")
    )


def finding_references(found: DataFrame, k: int = 20) -> DataFrame:
    return first_ids(found, ["code"], "snapshot_id", k, "references")


def contract_quality(
    snapshots: DataFrame, forms: DataFrame, spec: ContractSpec
) -> DataFrame:
    """Snapshot and field rates, overall and per group; long form.

    Field rates come from counts inside each snapshot's array, so nothing is exploded.
    """
    rows = effective_form(snapshots, forms)

    def inside(test) -> Column:
        return F.size(F.filter("fields", test))

    fresh = F.col("freshness") == "fresh"
    conflict = F.col("conflict_status") == "detected"
    agrees = F.col("requirements_contract_version") == spec.contract_version
    supported = F.col("form_no").isNotNull()
    share = {
        "supported_form_rate": supported,
        "fresh_rate": fresh,
        "stale_snapshot_rate": F.col("freshness") == "stale",
        "conflict_rate": conflict,
        "source_warning_coverage": F.size("source_warning_codes") > 0,
        "manual_review_state_availability": F.col("manual_review_state") != "unavailable",
        "requirements_version_agreement": agrees,
        "supersession_integrity": (F.col("source_record_version") == 1)
        | F.col("superseded_snapshot_id").isNotNull(),
        "usable_input_coverage": fresh & (F.col("conflict_status") == "none") & agrees & supported,
        "contract_related_abstention_rate": ~fresh | conflict | ~agrees,
    }
    fields = {
        "field_state_completeness": lambda f: F.size(f["provenance_references"]) > 0,
        "applicability_coverage": lambda f: f["applicable"].isNotNull(),
        "unknown_state_rate": lambda f: f["state"].isin("unknown", "pending_source_update"),
        "unsupported_state_rate": lambda f: f["state"] == "unsupported",
    }
    dims = {
        "overall": F.lit("all"),
        "source_system": F.col("source_system"),
        "form_version": F.col("form_version"),
        "month": F.date_format("available_at", "yyyy-MM"),
        "producer_system": F.col("producer_system"),
    }
    pairs = [F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in dims.items()]
    delay = (F.unix_micros("available_at") - F.unix_micros("source_event_at")) / 60e6
    slim = rows.select(
        *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in share.items()],
        *[inside(t).alias(n) for n, t in fields.items()],
        F.size("fields").alias("_fields"),
        delay.alias("_delay"),
        F.inline(F.array(*pairs)),
    )
    got = slim.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("snapshots"),
        *[F.avg(n).alias(n) for n in share],
        *[(F.sum(n) / F.greatest(F.sum("_fields"), F.lit(1))).alias(n) for n in fields],
        F.avg("_delay").alias("mean_update_delay_minutes"),
    )
    names = [*share, *fields, "mean_update_delay_minutes"]
    entries = [F.struct(F.lit(n).alias("measure"), F.col(n).alias("number")) for n in names]
    return got.select("dimension", "value", "snapshots", F.inline(F.array(*entries)))


def contract_distributions(snapshots: DataFrame) -> DataFrame:
    """(series, label, state, snapshots): field states, freshness, conflicts, forms, abstentions."""
    abstains = (F.col("freshness") != "fresh") | (F.col("conflict_status") == "detected")
    none = F.lit(None).cast("string")
    singles = F.filter(
        F.array(
            F.struct(F.lit("freshness").alias("series"), F.col("freshness").alias("label"), none.alias("state")),
            F.struct(F.lit("conflict").alias("series"), F.col("conflict_status").alias("label"), none.alias("state")),
            F.struct(F.lit("form_version").alias("series"), F.col("form_version").alias("label"), none.alias("state")),
            F.struct(
                F.lit("source_abstention").alias("series"),
                F.when(abstains, F.col("source_system")).alias("label"),
                none.alias("state"),
            ),
        ),
        lambda x: x["label"].isNotNull(),
    )
    states = F.transform(
        "fields",
        lambda f: F.struct(
            F.lit("field_state").alias("series"), f["field_id"].alias("label"), f["state"].alias("state")
        ),
    )
    return (
        snapshots.select(F.inline(F.concat(singles, states)))
        .groupBy("series", "label", "state")
        .agg(F.count(F.lit(1)).alias("snapshots"))
    )


def recall_funnel(ceilings: DataFrame) -> DataFrame:
    """Stages of the overall ceiling as rows."""
    names = {
        "hidden_positives": "positives",
        "observable": "observable",
        "observable_in_time": "timely",
        "policy_permitted": "permitted",
        "surfaced": "surfaced",
    }
    pairs = [F.struct(F.lit(s).alias("stage"), F.col(c).alias("cases")) for s, c in names.items()]
    return ceilings.where(F.col("dimension") == "overall").select(F.inline(F.array(*pairs)))


def observability(
    snapshots: DataFrame,
    labels: DataFrame,
    forms: DataFrame,
    outcomes: DataFrame,
    spec: ContractSpec,
) -> DataFrame:
    """One row per positive case: why it was or was not observable.

    outcomes: (case_id, detected, surfaced, confirmation_miss) booleans.  Labels
    are used only to pick the positive cases, as of the first arrival.
    """
    rows = with_document(effective_form(snapshots, forms), spec)
    good = (
        F.col("doc_applicable")
        & F.col("doc_state").isin("absent", "verification_required")
        & (F.col("requirements_contract_version") == spec.contract_version)
        & usable(spec)
    )
    reviewing = F.col("manual_review_state").isin("started", "completed")
    at = F.struct(*SNAPSHOT_ORDER)
    first = F.struct(
        "available_at", "form_no", "requirements_contract_version", "conflict_status", "freshness",
        "doc_state", "doc_applicable", "manual_review_state", "source_system", "form_version",
    )
    per = rows.groupBy("case_id").agg(
        F.min_by(first, at).alias("first"),
        F.count(F.lit(1)).alias("snapshots"),
        F.min(F.when(good, F.col("available_at"))).alias("usable_at"),
        F.min(F.when(reviewing, F.col("available_at"))).alias("review_at"),
    )
    judged = asof_label(per.withColumn("as_of", F.col("first.available_at")), labels)
    base = (
        judged.where(F.col("label") == "positive")
        .join(outcomes, "case_id", "left")
        .withColumns(
            {c: F.coalesce(c, F.lit(False)) for c in ("detected", "surfaced", "confirmation_miss")}
        )
    )
    window = plus_micros(F.col("first.available_at"), F.lit(spec.useful_minutes * 60_000_000))
    useful = F.least(window, F.col("review_at"))
    has = F.col("usable_at").isNotNull()
    timely = has & (F.col("usable_at") <= F.col("latest_useful_at"))
    f = F.col("first")
    category = (
        F.when(
            f["form_no"].isNull() | (f["requirements_contract_version"] != spec.contract_version),
            "unsupported_form_contract",
        )
        .when(f["conflict_status"] == "detected", "conflicting_source_state")
        .when(f["freshness"] != "fresh", "stale_source_state")
        .when(has & (F.col("usable_at") > F.col("latest_useful_at")), "evidence_arrived_too_late")
        .when(f["doc_applicable"].isNull(), "conditional_applicability_unknown")
        .when(
            f["doc_state"].isin("unknown", "pending_source_update"), "unknown_absent_ambiguity"
        )
        .when(~has, "source_evidence_unavailable")
        .when(F.col("confirmation_miss"), "confirmation_window_miss")
        .when(~F.col("detected"), "detector_rule_miss")
        .when(~F.col("surfaced"), "capacity_not_surfaced")
        .otherwise("detected")
    )
    prohibited = F.col("category").isin("conflicting_source_state", "stale_source_state")
    status = (
        F.when(prohibited, "policy_prohibited")
        .when(F.col("detected") & F.col("timely"), "observable_and_detected")
        .when(F.col("timely"), "observable_but_missed")
        .when(has, "observable_too_late")
        .when(
            F.col("category").isin("unknown_absent_ambiguity", "conditional_applicability_unknown"),
            "partially_observable",
        )
        .otherwise("unobservable")
    )
    own_fault = F.col("category").isin(
        "confirmation_window_miss", "detector_rule_miss", "capacity_not_surfaced", "detected"
    )
    underway = f["manual_review_state"].isin("started", "completed")
    return (
        base.withColumn("latest_useful_at", useful)
        .withColumns({"timely": timely, "category": category, "observable": has})
        .withColumns(
            {
                "status": status,
                "source_change": ~own_fault,
                "detector_change": F.col("category").isin(
                    "confirmation_window_miss", "detector_rule_miss"
                ),
                "review_underway": underway,
                "also_confirmation_miss": F.col("confirmation_miss")
                & (F.col("category") != "confirmation_window_miss"),
                "form_support": F.when(f["form_no"].isNull(), "unsupported").otherwise("supported"),
                "source_system": f["source_system"],
                "form_version": f["form_version"],
                "freshness": f["freshness"],
                "manual_review": f["manual_review_state"],
            }
        )
        .withColumn("recoverable", F.col("timely") | F.col("source_change"))
        .drop("first", "as_of", "label")
    )


def recall_ceilings(assessed: DataFrame) -> DataFrame:
    """Per cohort: positives, observable, timely, permitted, surfaced and their ratios."""
    pairs = [F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value"))]
    pairs += [
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
        for d in ("source_system", "form_version", "freshness", "form_support", "manual_review")
    ]
    rows = assessed.select(
        "observable", "timely", "detected", "surfaced", F.inline(F.array(*pairs))
    )
    got = rows.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("positives"),
        F.count_if("observable").alias("observable"),
        F.count_if("timely").alias("timely"),
        F.count_if("observable").alias("permitted"),
        F.count_if("observable").alias("explicit"),
        F.count_if("surfaced").alias("surfaced"),
        F.count_if("detected").alias("_detected"),
    )
    return got.select(
        "dimension", "value", "positives", "observable", "timely", "permitted", "explicit", "surfaced",
        F.try_divide("observable", "positives").alias("contract_ceiling"),
        F.try_divide("timely", "positives").alias("useful_time_ceiling"),
        F.try_divide("_detected", "positives").alias("detected_recall"),
        F.try_divide("surfaced", "positives").alias("surfaced_recall"),
    )
