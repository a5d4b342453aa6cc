"""Row validation, dataset checks and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.ids import normalise_key
from ..functions.ordered import scan
from ..session import Scale
from ..spec import BaselineSpec
from .metrics import METRICS
from .timeline import IDENTITY, ORDER, case_flags, empty_cases, orphan_events


def violations(checks: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds (null counts as not holding)."""
    coded = F.array(*[F.when(cond, F.lit(code)) for code, cond in checks.items()])
    return F.filter(coded, lambda x: x.isNotNull())


def validate_case_rows(cases: DataFrame, pattern: str) -> DataFrame:
    """Adds `violations`; an empty array means a valid row."""
    ended = F.col("status").isin(*vocab.TERMINAL_STATUSES)
    checks = {
        "identifier_pattern": ~F.col("external_source_id").rlike(pattern),
        "unknown_status": ~F.col("status").isin(*vocab.STATUSES),
        "unknown_referral_source": ~F.col("referral_source").isin(*vocab.REFERRAL_SOURCES),
        "unknown_service_line": ~F.col("service_line").isin(*vocab.SERVICE_LINES),
        "terminal_without_closed_at": ended & F.col("closed_at").isNull(),
        "closed_at_without_terminal": ~ended & F.col("closed_at").isNotNull(),
        "closed_before_received": F.col("closed_at") < F.col("received_at"),
        "updated_before_created": F.col("updated_at") < F.col("created_at"),
        "missing_required_value": F.col("received_at").isNull() | F.col("status").isNull(),
    }
    return cases.withColumn("violations", violations(checks))


def reason_rules(spark: SparkSession) -> DataFrame:
    rows = [(e, r) for e, reasons in vocab.REASONS_BY_EVENT.items() for r in reasons]
    return spark.createDataFrame(rows, "event_type string, reason_code string")


def validate_event_rows(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `violations`.  `rules` lists the allowed (event type, reason) pairs."""
    needed = rules.select("event_type").distinct().withColumn("_needs", F.lit(True))
    allowed = rules.withColumn("_allowed", F.lit(True))
    got = events.join(F.broadcast(needed), "event_type", "left").join(
        F.broadcast(allowed), ["event_type", "reason_code"], "left"
    )
    needs = F.coalesce("_needs", F.lit(False))
    checks = {
        "unknown_event_type": ~F.col("event_type").isin(*vocab.EVENT_TYPES),
        "unknown_actor_type": ~F.col("actor_type").isin(*vocab.ACTOR_TYPES),
        "external_id_pattern": ~F.col("external_event_id").rlike(vocab.EXTERNAL_EVENT_PATTERN),
        "actor_id_pattern": ~F.col("actor_id").rlike(vocab.ACTOR_PATTERN),
        "actor_id_required": F.col("actor_type").isin(*vocab.INTERNAL_ACTORS)
        & F.col("actor_id").isNull(),
        "reason_required": needs & F.col("reason_code").isNull(),
        "reason_not_allowed": needs & F.col("reason_code").isNotNull() & F.col("_allowed").isNull(),
    }
    return got.withColumn("violations", violations(checks)).drop("_needs", "_allowed")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)"""
    bad = F.size("violations") > 0
    return checked.where(~bad).drop("violations"), checked.where(bad)


def violation_counts(checked: DataFrame) -> DataFrame:
    return (
        checked.select(F.explode("violations").alias("code"))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def json_keys(column: Column) -> Column:
    """All keys of a JSON text at any depth, normalised.

    Keys that are written with JSON escapes are left out here; ``json_keys_exact``
    covers them.
    """
    raw = F.regexp_extract_all(column, F.lit(r'"([^"\\]+)"\s*:'), F.lit(1))
    return F.transform(raw, normalise_key)


def forbidden_key_scan(df: DataFrame, column: str, keys=vocab.FORBIDDEN_KEYS) -> DataFrame:
    """Adds `forbidden_keys`: sorted normalised keys of the JSON text that are not permitted."""
    banned = F.array(*[F.lit(k) for k in keys])
    escaped = F.col(column).contains("\\")
    plain = F.array_intersect(json_keys(F.col(column)), banned)
    # a backslash may hide a key: resolve \uXXXX spellings by decoding the text as a JSON string
    decoded = F.array_intersect(json_keys(_unescape(F.col(column))), banned)
    found = F.when(escaped, F.array_union(plain, decoded)).otherwise(plain)
    return df.withColumn("forbidden_keys", F.array_sort(F.coalesce(found, F.array())))


def _unescape(text: Column) -> Column:
    """Write printable-ASCII \\u00XX escapes as characters."""
    out = text
    for code in [*range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, 0x2D, 0x20]:
        out = F.regexp_replace(out, rf"(?i)\\u00{code:02x}", chr(code))
    return out


def top_level_forbidden(column: str, keys=vocab.FORBIDDEN_KEYS) -> Column:
    """True when a top-level key equals a forbidden key as written."""
    return F.arrays_overlap(F.json_object_keys(column), F.array(*[F.lit(k) for k in keys]))


# pattern -> text that every match of it must contain: a plain search that spares most regex runs
PATTERN_HINTS = {
    vocab.SENSITIVE_PATTERNS["email"]: ("@",),
    vocab.SENSITIVE_PATTERNS["identifier"]: ("nhs", "patient"),
}


def text_safety_scan(
    df: DataFrame,
    column: str,
    terms=vocab.FORBIDDEN_TERMS,
    patterns=vocab.SENSITIVE_PATTERNS,
    hints=PATTERN_HINTS,
) -> DataFrame:
    """Adds `findings`: forbidden terms and sensitive patterns found in the lower-cased text."""
    text = F.col("_lower")
    checks = {f"term:{t}": text.contains(t) for t in terms}
    for name, pattern in patterns.items():
        test = text.rlike(pattern)
        if pattern in hints:
            likely = F.lit(False)
            for part in hints[pattern]:
                likely = likely | text.contains(part)
            test = likely & test
        checks[f"pattern:{name}"] = test
    lowered = df.withColumn("_lower", F.lower(F.col(column)))
    return lowered.withColumn("findings", violations(checks)).drop("_lower")


def log_quality(
    events: DataFrame, cases: DataFrame, spec: BaselineSpec, scale: Scale, mapped=tuple(vocab.ACTIVITY_LABELS)
) -> DataFrame:
    """One row: what was received, kept, and left out, and why.

    Events whose type has no activity are left out of the log and counted as unsupported mappings.
    """
    flags = case_flags(events, cases, spec, scale, mapped)
    included = F.col("events") - F.col("unmapped")
    ok = F.col("supported") & (included > 0)
    if spec.reject_duplicates:
        ok = ok & (F.col("duplicates") == 0)
    per_case = flags.agg(
        F.count_if(ok).alias("traces_included"),
        F.coalesce(F.sum(F.when(ok, included)), F.lit(0)).alias("events_included"),
        F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unsupported_mappings"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicate_events"),
        F.count_if(F.col("events") == 0).alias("empty_cases"),
        F.count_if(~F.col("supported")).alias("unsupported_cases"),
        F.count_if(F.col("identical_timestamps")).alias("identical_timestamp_cases"),
        F.count_if(F.col("out_of_order")).alias("out_of_order_cases"),
    )
    received = cases.agg(F.count(F.lit(1)).alias("cases_received"))
    totals = events.agg(F.count(F.lit(1)).alias("events_received"))
    orphans = orphan_events(events, cases).agg(F.count(F.lit(1)).alias("orphan_events"))
    # four one-row results side by side
    return received.crossJoin(totals).crossJoin(orphans).crossJoin(per_case)


def metric_status_counts(wide: DataFrame) -> DataFrame:
    entries = [
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_status").alias("status")) for m in METRICS
    ]
    return (
        wide.select(F.inline(F.array(*entries)))
        .groupBy("metric", "status")
        .agg(F.count(F.lit(1)).alias("cases"))
    )


def analysis_quality(wide: DataFrame) -> DataFrame:
    """Coverage of the analysed cases in long form (measure, cases)."""
    ended = F.col("closed_at").isNotNull()
    tests = {
        "cases_analysed": F.lit(True),
        "missing_received": ~F.col("has_received"),
        "missing_check": F.col("checks") == 0,
        "missing_terminal": ended & (F.col("terminals") == 0),
        "several_terminals": F.col("terminals") > 1,
        "identical_timestamps": F.col("identical_timestamps"),
        "delayed_ingestion": F.col("delayed_event_count") > 0,
        "out_of_order_ingestion": F.col("out_of_order_ingestion"),
        "unmatched_waits": F.col("unmatched_waits") > 0,
        "no_assigned_team": F.col("assigned_team").isNull(),
    }
    one = wide.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    pairs = [F.struct(F.lit(n).alias("measure"), F.col(n).alias("cases")) for n in tests]
    return one.select(F.inline(F.array(*pairs)))


def dataset_validation(events: DataFrame, cases: DataFrame, scale: Scale) -> DataFrame:
    """Counts of invalid records and of expected defects, long form (code, severity, rows)."""
    ended = F.col("event_type").isin(*vocab.TERMINAL_EVENTS)
    ends = events.groupBy("case_id").agg(F.count_if(ended).alias("_ends"))
    terminal = F.col("status").isin(*vocab.TERMINAL_STATUSES)
    closed = F.col("closed_at").isNotNull()
    n_ends = F.coalesce("_ends", F.lit(0))
    bad_terminal = (terminal & (~closed | (n_ends != 1))) | (~terminal & (closed | (n_ends > 0)))

    def total(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("rows")).select(
            F.lit(name).alias("code"), "rows"
        )

    def extra(by: list[str], name: str) -> DataFrame:
        counted = events.groupBy(*by).agg((F.count(F.lit(1)) - 1).alias("_x"))
        return total(counted, name, F.sum("_x"))

    known = events.join(cases.select("case_id"), "case_id", "left_semi")
    ordered = scan(
        known, ["case_id"], ORDER, scale, previous={"prev_ingested": F.col("ingested_at")}
    )
    disorder = ordered.where(F.col("ingested_at") < F.col("prev_ingested")).select("case_id").distinct()
    one = F.count(F.lit(1))
    parts = [
        total(orphan_events(events, cases), "orphan_events", one),
        extra(["event_id"], "duplicate_event_ids"),
        extra(["source_system", "external_event_id"], "duplicate_external_events"),
        total(
            cases.join(ends, "case_id", "left"), "invalid_terminal_cases", F.count_if(bad_terminal)
        ),
        total(empty_cases(events, cases), "cases_without_events", one),
        total(
            events.select("schema_version").unionByName(cases.select("schema_version")),
            "schema_version_mismatches",
            F.count_if(F.col("schema_version") != 1),
        ),
        total(
            forbidden_key_scan(events.select("metadata"), "metadata"),
            "forbidden_metadata",
            F.count_if(F.size("forbidden_keys") > 0),
        ),
        total(
            events,
            "timezone_issues",
            F.count_if(F.col("event_at").isNull() | F.col("ingested_at").isNull()),
        ),
        total(disorder, "out_of_order_ingestion", one),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn(
        "severity",
        F.when(F.col("code") == "out_of_order_ingestion", "expected_defect").otherwise("invalid"),
    )


def manifest_counts(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Distribution counters (side, dimension, value, rows)."""

    def spread(df: DataFrame, side: str, dims: tuple[str, ...]) -> DataFrame:
        pairs = [
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dims
        ]
        return (
            df.select(F.inline(F.array(*pairs)))
            .groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(side).alias("side"), "dimension", "value", "rows")
        )

    return spread(events, "events", ("event_type", "source_system", "actor_type")).unionByName(
        spread(cases, "cases", ("status", "service_line", "referral_source"))
    )
