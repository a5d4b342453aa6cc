"""Registered queries: cohorts, quality, process mining, conformance, bottlenecks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions.stats import first_ids, quantiles_by_rank, summarise
from ..operators import bottlenecks as bn
from ..operators import cohorts, conformance, mining, quality, variants
from ..operators.review import percentile_nearest
from ..sources.tables import session_log, table, table_scale
from ..spec import MiningSpec, ReferenceModel, governed_model, strict_model
from . import sql as q
from .registry import joined, query, tidy
from .sql import with_
from .workspace import MINING, Workspace

_DIMS = ("referral_source", "service_line", "source_system", "assigned_team", "terminal_outcome")

# --- cohorts ------------------------------------------------------------------
MEMBERS = (
    q.CM
    + ",\nmem AS (SELECT cm.*, 'overall' AS dimension, 'all' AS value FROM cm"
    + "".join(f" UNION ALL SELECT cm.*, '{d}', {d} FROM cm WHERE {d} IS NOT NULL" for d in _DIMS)
    + ")"
)
_ENDED = f"terminal_outcome IN {q.quoted(vocab.TERMINAL_STATUSES)}"
_USABLE = " + ".join(
    f"CASE WHEN {m}_status IN ('calculated', 'estimated', 'partial') THEN 1 ELSE 0 END" for m in cohorts.METRICS
)


def _count(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


_RATE_SQL = {
    "completion_rate": (_count("terminal_outcome = 'completed'"), _count(_ENDED)),
    "cancellation_rate": (_count("terminal_outcome = 'cancelled'"), _count(_ENDED)),
    "rejection_rate": (_count("terminal_outcome = 'rejected'"), _count(_ENDED)),
    "stuck_case_rate": (_count("is_stuck"), _count(f"NOT ({_ENDED})")),
    "first_pass_completeness_rate": (_count("first_pass_complete"), "count(first_pass_complete)"),
    "delayed_ingestion_rate": (_count("delayed_event_count > 0"), "count(*)"),
    "out_of_order_ingestion_rate": (_count("out_of_order_ingestion"), "count(*)"),
    "metric_availability_rate": (f"CAST(sum({_USABLE}) AS BIGINT)", f"count(*) * {len(cohorts.METRICS)}"),
}
RATES = (
    MEMBERS
    + ",\nrates AS ("
    + " UNION ALL ".join(
        f"SELECT dimension, value, count(*) AS cases, '{n}' AS metric, {a} AS numerator, {b} AS denominator "
        "FROM mem GROUP BY 1, 2"
        for n, (a, b) in _RATE_SQL.items()
    )
    + ")"
)
SUMMARIES_FROM_MEMBERS = (
    ",\nnums AS ("
    + " UNION ALL ".join(
        f"SELECT dimension, value, '{m}' AS metric, CASE WHEN {m}_status IN ('calculated', 'estimated') "
        f"THEN CAST({m} AS DOUBLE) END AS x FROM mem"
        for m in cohorts.SUMMARY_METRICS
    )
    + """),
sums AS (SELECT dimension, value, metric, count(*) AS cases, count(x) AS n, count(*) - count(x) AS excluded,
  avg(x) AS mean, median(x) AS median, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90,
  quantile_cont(x, 0.95) AS p95 FROM nums GROUP BY 1, 2, 3)"""
)
VALUES = (
    RATES
    + SUMMARIES_FROM_MEMBERS
    + """,
vals AS (
  SELECT dimension, value, cases, metric, CASE WHEN denominator > 0 THEN numerator / denominator END AS observed,
    denominator AS sample FROM rates
  UNION ALL SELECT dimension, value, cases, metric, mean, n FROM sums
)"""
)
_RULE_ROWS = ", ".join(
    f"('{kind}', '{metric}', '{direction}', '{dim}', {str(metric.endswith('_rate')).lower()})"
    for kind, metric, direction, dims in cohorts.FINDING_RULES
    for dim in dims
)
FINDINGS = (
    VALUES
    + f""",
rules(finding_type, metric, direction, dimension, is_rate) AS (VALUES {_RULE_ROWS}),
judged AS (
  SELECT v.*, r.finding_type, r.direction, r.is_rate, o.observed AS baseline, o.cases AS baseline_cases,
    v.observed - o.observed AS absolute_difference,
    CASE WHEN o.observed <> 0 THEN (v.observed - o.observed) / o.observed END AS relative_difference,
    CASE WHEN r.direction = 'higher' THEN 1 ELSE -1 END AS sign
  FROM vals v JOIN rules r USING (metric, dimension)
  JOIN (SELECT * FROM vals WHERE dimension = 'overall') o ON o.metric = v.metric
  WHERE v.cases >= 20 AND v.observed IS NOT NULL AND o.observed IS NOT NULL
),
found AS (
  SELECT replace(dimension || '-' || value || '-' || finding_type, '_', '-') AS finding_id, *,
    CASE WHEN CASE WHEN is_rate THEN sign * absolute_difference >= 0.2 ELSE sign * relative_difference >= 0.4 END
      THEN 'strong' ELSE 'material' END AS materiality
  FROM judged
  WHERE CASE WHEN is_rate THEN sign * absolute_difference >= 0.1 ELSE sign * relative_difference >= 0.2 END
)"""
)


@query(
    "cohort_rollup",
    with_(
        MEMBERS,
        f"""SELECT dimension, value, count(*) AS cases, {_count("terminal_outcome = 'completed'")} AS completed,
  {_count("terminal_outcome = 'cancelled'")} AS cancelled, {_count("terminal_outcome = 'rejected'")} AS rejected,
  {_count('is_stuck')} AS stuck FROM mem GROUP BY 1, 2""",
    ),
)
def cohort_rollup(spark, folder):
    return Workspace.of_sessions(spark, folder).rollup.select(
        "dimension", "value", "cases", "completed", "cancelled", "rejected", "stuck"
    )


@query(
    "cohort_rates",
    with_(
        RATES,
        "SELECT dimension, value, metric, numerator, denominator, "
        "CASE WHEN denominator > 0 THEN round(numerator / denominator, 6) END AS rate FROM rates",
    ),
)
def cohort_rates(spark, folder):
    got = cohorts.cohort_rates(Workspace.of_sessions(spark, folder).rollup)
    return tidy(got.select("dimension", "value", "metric", "numerator", "denominator", "rate"))


@query(
    "cohort_summaries",
    with_(
        MEMBERS + SUMMARIES_FROM_MEMBERS,
        "SELECT dimension, value, metric, n, excluded, round(mean, 6) AS mean, round(median, 6) AS median, "
        "round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95 FROM sums",
    ),
)
def cohort_summaries(spark, folder):
    got = Workspace.of_sessions(spark, folder).summaries
    return tidy(got.select("dimension", "value", "metric", "n", "excluded", "mean", "median", "p75", "p90", "p95"))


@query(
    "cohort_min_size",
    with_(MEMBERS, "SELECT dimension, value FROM mem GROUP BY 1, 2 HAVING count(*) >= 20"),
)
def cohort_min_size(spark, folder):
    return Workspace.of_sessions(spark, folder).rollup.where("eligible").select("dimension", "value")


@query(
    "findings",
    with_(
        FINDINGS,
        "SELECT finding_id, finding_type, dimension, value, metric, round(observed, 6) AS observed, "
        "round(baseline, 6) AS baseline, round(absolute_difference, 6) AS absolute_difference, "
        "round(relative_difference, 6) AS relative_difference, cases AS cohort_cases, baseline_cases, materiality FROM found",
    ),
)
def findings(spark, folder):
    return tidy(
        Workspace.of_sessions(spark, folder).findings.select(
            "finding_id", "finding_type", "dimension", "value", "metric", "observed", "baseline",
            "absolute_difference", "relative_difference", "cohort_cases", "baseline_cases", "materiality",
        )
    )


_SIGNAL = "CASE metric " + " ".join(
    [
        "WHEN 'first_pass_completeness_rate' THEN CASE WHEN NOT first_pass_complete THEN 1e9 END",
        "WHEN 'stuck_case_rate' THEN CASE WHEN is_stuck THEN 1e9 END",
        "WHEN 'delayed_ingestion_rate' THEN CASE WHEN delayed_event_count > 0 THEN 1e9 END",
    ]
    + [
        f"WHEN '{m}' THEN {m}"
        for m in sorted({r[1] for r in cohorts.FINDING_RULES if not r[1].endswith("_rate")})
    ]
) + " END"


@query(
    "topk_support",
    with_(
        FINDINGS,
        f"""SELECT finding_id, string_agg(case_id, ',' ORDER BY case_id) AS case_ids FROM (
  SELECT finding_id, case_id, row_number() OVER (PARTITION BY finding_id ORDER BY case_id) AS rn
  FROM mem JOIN found f USING (dimension, value) WHERE {_SIGNAL} > baseline) WHERE rn <= 25 GROUP BY 1""",
    ),
)
def topk_support(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    got = cohorts.finding_support(ws.wide, ws.findings, ws.spec)
    return got.select("finding_id", joined("supporting_case_ids").alias("case_ids"))


def _expected(spark):
    rows = [
        ("incomplete_referrals", ["lower_first_pass_completeness"], "referral_source", "gp_practice"),
        ("assignment_congestion", ["longer_assignment_wait", "longer_booking_time"], "service_line", "neurology"),
        ("scheduling_shortage", ["elevated_failed_scheduling"], "service_line", "respiratory"),
        ("handoff_cost", ["elevated_reassignment", "elevated_handoffs"], "service_line", "dermatology"),
    ]
    return spark.createDataFrame(rows, "pattern string, finding_types array<string>, dimension string, value string")


@query(
    "join_expected_labels",
    with_(
        FINDINGS
        + """,
expected(pattern, finding_type, dimension, value) AS (VALUES
  ('incomplete_referrals', 'lower_first_pass_completeness', 'referral_source', 'gp_practice'),
  ('assignment_congestion', 'longer_assignment_wait', 'service_line', 'neurology'),
  ('assignment_congestion', 'longer_booking_time', 'service_line', 'neurology'),
  ('scheduling_shortage', 'elevated_failed_scheduling', 'service_line', 'respiratory'),
  ('handoff_cost', 'elevated_reassignment', 'service_line', 'dermatology'),
  ('handoff_cost', 'elevated_handoffs', 'service_line', 'dermatology'))""",
        """SELECT pattern, dimension, value, count(finding_id) AS matches, coalesce(max(cases), 0) AS sample_size,
  CASE WHEN count(finding_id) > 0 THEN 'detected' ELSE 'missed' END AS outcome
FROM expected LEFT JOIN found USING (finding_type, dimension, value) GROUP BY 1, 2, 3
UNION ALL SELECT '(extra)', dimension, value, count(*), max(cases), 'extra' FROM found
WHERE (finding_type, dimension, value) NOT IN (SELECT finding_type, dimension, value FROM expected) GROUP BY 2, 3""",
    ),
)
def join_expected_labels(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return cohorts.expected_labels(ws.findings, _expected(spark))


# --- quality --------------------------------------------------------------------
@query(
    "analysis_quality",
    with_(
        q.CM,
        "SELECT metric, status, count(*) AS cases FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}_status AS status FROM cm" for m in cohorts.METRICS)
        + ") GROUP BY 1, 2",
    ),
)
def analysis_quality(spark, folder):
    return quality.metric_status_counts(Workspace.of_sessions(spark, folder).wide)


_COVERAGE = {
    "cases_analysed": "true",
    "missing_received": "NOT has_received",
    "missing_check": "checks = 0",
    "missing_terminal": "closed_at IS NOT NULL AND terminals = 0",
    "several_terminals": "terminals > 1",
    "identical_timestamps": "identical_timestamps",
    "delayed_ingestion": "delayed_event_count > 0",
    "out_of_order_ingestion": "out_of_order_ingestion",
    "unmatched_waits": "unmatched_waits > 0",
    "no_assigned_team": "assigned_team IS NULL",
}


@query(
    "analysis_coverage",
    with_(q.CM, " UNION ALL ".join(f"SELECT '{n}' AS measure, {_count(w)} AS cases FROM cm" for n, w in _COVERAGE.items())),
)
def analysis_coverage(spark, folder):
    return quality.analysis_quality(Workspace.of_sessions(spark, folder).wide)


# one type is left out of the mapping, so that the check sees unsupported events
_MAPPED = tuple(e for e in vocab.EVENT_TYPES if e != "appointment_scheduling_failed")


@query(
    "log_quality",
    with_(
        q.TL
        + f""",
fl AS (SELECT c.case_id, count(t.event_id) AS events,
  count(t.event_id) FILTER (WHERE t.event_type NOT IN {q.quoted(_MAPPED)}) AS unmapped, coalesce(bool_or(t.prev_at = t.event_at), false) AS same,
  coalesce(bool_or(t.ingested_at < t.prev_ingested), false) AS disorder,
  any_value(c.schema_version) = 1 AND NOT coalesce(bool_or(t.schema_version <> 1), false) AS ok
  FROM cases c LEFT JOIN tl t USING (case_id) GROUP BY 1)""",
        """SELECT (SELECT count(*) FROM cases) AS cases_received, (SELECT count(*) FROM ev) AS events_received,
  (SELECT count(*) FROM ev WHERE case_id NOT IN (SELECT case_id FROM cases)) AS orphan_events,
  count(*) FILTER (WHERE ok AND events > unmapped) AS traces_included,
  CAST(sum(events - unmapped) FILTER (WHERE ok) AS BIGINT) AS events_included, CAST(sum(unmapped) AS BIGINT) AS unsupported_mappings,
  (SELECT count(*) FROM copies WHERE copy_no > 1) AS duplicate_events,
  count(*) FILTER (WHERE events = 0) AS empty_cases, count(*) FILTER (WHERE NOT ok) AS unsupported_cases,
  count(*) FILTER (WHERE same) AS identical_timestamp_cases, count(*) FILTER (WHERE disorder) AS out_of_order_cases
FROM fl""",
    ),
)
def log_quality(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return quality.log_quality(ws.log.events, ws.log.cases, ws.spec, ws.scale, _MAPPED)


@query(
    "dataset_validation",
    with_(
        q.TL,
        f"""SELECT 'orphan_events' AS code, count(*) AS rows, 'invalid' AS severity FROM ev WHERE case_id NOT IN (SELECT case_id FROM cases)
UNION ALL SELECT 'duplicate_event_ids', count(*) - count(DISTINCT event_id), 'invalid' FROM ev
UNION ALL SELECT 'duplicate_external_events', count(*) - count(DISTINCT (source_system, external_event_id)), 'invalid' FROM ev
UNION ALL SELECT 'invalid_terminal_cases', count(*), 'invalid' FROM cases c LEFT JOIN
  (SELECT case_id, {_count('event_type IN ' + q._TERMINAL)} AS ends FROM ev GROUP BY 1) e USING (case_id)
  WHERE CASE WHEN status IN {q.quoted(vocab.TERMINAL_STATUSES)} THEN closed_at IS NULL OR coalesce(ends, 0) <> 1
        ELSE closed_at IS NOT NULL OR coalesce(ends, 0) > 0 END
UNION ALL SELECT 'cases_without_events', count(*), 'invalid' FROM cases WHERE case_id NOT IN (SELECT case_id FROM ev)
UNION ALL SELECT 'schema_version_mismatches', (SELECT count(*) FROM ev WHERE schema_version <> 1) +
  (SELECT count(*) FROM cases WHERE schema_version <> 1), 'invalid'
UNION ALL SELECT 'forbidden_metadata', 0, 'invalid' UNION ALL SELECT 'timezone_issues', 0, 'invalid'
UNION ALL SELECT 'out_of_order_ingestion', count(DISTINCT case_id), 'expected_defect' FROM
  (SELECT case_id, ingested_at < lag(ingested_at) OVER (PARTITION BY case_id ORDER BY event_at, event_id) AS late
   FROM ev WHERE case_id IN (SELECT case_id FROM cases)) WHERE late""",
    ),
)
def dataset_validation(spark, folder):
    log = session_log(spark, folder)
    return quality.dataset_validation(log.events, log.cases, log.scale)


@query(
    "manifest_counts",
    with_(
        q.CASES,
        " UNION ALL ".join(
            f"SELECT '{side}' AS side, '{d}' AS dimension, {d} AS value, count(*) AS rows FROM {t} GROUP BY {d}"
            for side, t, dims in (
                ("events", "ev", ("event_type", "source_system", "actor_type")),
                ("cases", "cases", ("status", "service_line", "referral_source")),
            )
            for d in dims
        ),
    ),
)
def manifest_counts(spark, folder):
    log = session_log(spark, folder)
    return quality.manifest_counts(log.events, log.cases)


# --- statistics -----------------------------------------------------------------
@query(
    "numeric_summary",
    """SELECT l_returnflag AS flag, l_linestatus AS line_status, count(*) AS n, round(avg(l_extendedprice), 6) AS mean,
  round(median(l_extendedprice), 6) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1, 2""",
)
def numeric_summary(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"), "l_extendedprice"
    )
    got = summarise(
        lines, ["flag", "line_status"], "l_extendedprice", (0.5, 0.75, 0.9, 0.95), table_scale(spark, folder, "lineitem")
    )
    return tidy(got.drop("p50"))


@query(
    "numeric_summary_by_rank",
    """SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def numeric_summary_by_rank(spark, folder):
    # the form used when a group is too large for one task
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    got = quantiles_by_rank(lines, ["flag"], "l_extendedprice", (0.5, 0.99), table_scale(spark, folder, "lineitem"))
    return tidy(got.select("flag", F.col("_q0").alias("p50"), F.col("_q1").alias("p99")))


@query(
    "percentile_nearest",
    """SELECT flag, p95 FROM (SELECT l_returnflag AS flag, l_extendedprice AS p95,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rn,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
WHERE rn = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))""",
)
def percentile_nearest_(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return percentile_nearest(lines, ["flag"], "l_extendedprice", 0.95, table_scale(spark, folder, "lineitem"), "p95")


# --- process mining -------------------------------------------------------------
@query(
    "activity_stats",
    with_(
        q.PL,
        """SELECT activity, CAST(sum(n) AS BIGINT) AS frequency, count(*) AS cases, round(sum(m) / sum(n), 6) AS manual_rate,
  round(sum(p) / sum(n), 6) AS mean_position, count(*) FILTER (WHERE n > 1) AS repeating_cases FROM (
  SELECT activity, case_id, count(*) AS n, count(*) FILTER (WHERE manual) AS m, sum(pos) AS p FROM pl GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def activity_stats(spark, folder):
    return tidy(mining.activity_stats(Workspace.of_sessions(spark, folder).plog))


_HANDOFF = (
    f"coalesce(actor_type IN {q._INTERNAL} AND next_actor_type IN {q._INTERNAL} AND owner <> next_owner, false)"
)
_REWORK = f"(target IN {q.quoted(MINING.rework_activities)} OR source = target)"
TRANSITIONS_FROM_PL = f""",
worked AS (SELECT *, {q.business('event_at', 'next_at')} AS work FROM edges),
ts AS (
  SELECT 'transition-' || substr(sha256(source || chr(31) || target), 1, 12) AS transition_id, source, target,
    count(*) AS frequency, count(DISTINCT case_id) AS cases,
    count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM pl) AS case_share,
    avg(hours) AS hours_mean, median(hours) AS hours_median, min(hours) AS hours_min, max(hours) AS hours_max,
    quantile_cont(hours, 0.75) AS hours_p75, quantile_cont(hours, 0.9) AS hours_p90, quantile_cont(hours, 0.95) AS hours_p95,
    avg(work) AS work_mean, median(work) AS work_median, quantile_cont(work, 0.9) AS work_p90,
    avg(CAST(manual OR next_manual AS INT)) AS manual_rate, avg(CAST({_HANDOFF} AS INT)) AS handoff_rate,
    avg(CAST({_REWORK} AS INT)) AS rework_rate, target IN {q.quoted(vocab.TERMINAL_ACTIVITIES)} AS terminal
  FROM worked GROUP BY source, target
)"""
_TS_DOUBLES = (
    "case_share", "hours_mean", "hours_median", "hours_min", "hours_max", "hours_p75", "hours_p90", "hours_p95",
    "work_mean", "work_median", "work_p90", "manual_rate", "handoff_rate", "rework_rate",
)
_TS_COLUMNS = ("transition_id", "source", "target", "frequency", "cases", "terminal", *_TS_DOUBLES)
_TS_SELECT = "transition_id, source, target, frequency, cases, terminal, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _TS_DOUBLES
)


@query("transition_stats", with_(q.PL + TRANSITIONS_FROM_PL, f"SELECT {_TS_SELECT} FROM ts"))
def transition_stats(spark, folder):
    return tidy(Workspace.of_sessions(spark, folder).transitions.select(*_TS_COLUMNS))


@query(
    "edge_handoff",
    with_(q.PL, f"SELECT case_id, event_id, {_HANDOFF} AS handoff FROM edges"),
)
def edge_handoff(spark, folder):
    pairs = mining.edges(Workspace.of_sessions(spark, folder).plog)
    return pairs.select("case_id", "event_id", mining.handoff(MINING).alias("handoff"))


@query(
    "transition_support",
    with_(
        q.PL,
        """SELECT source, target, string_agg(case_id, ',' ORDER BY case_id) AS case_ids FROM (
  SELECT source, target, case_id, row_number() OVER (PARTITION BY source, target ORDER BY case_id) AS rn
  FROM (SELECT DISTINCT source, target, case_id FROM edges)) WHERE rn <= 25 GROUP BY 1, 2""",
    ),
)
def transition_support(spark, folder):
    got = mining.transition_support(Workspace.of_sessions(spark, folder).plog)
    return got.select("source", "target", joined("supporting_case_ids").alias("case_ids"))


@query(
    "filter_edges",
    with_(
        q.PL,
        "SELECT source, target, count(*) AS frequency FROM edges GROUP BY 1, 2 HAVING count(*) >= 5 "
        "ORDER BY 3 DESC, 1, 2 LIMIT 100",
    ),
)
def filter_edges(spark, folder):
    return mining.filter_edges(mining.dfg_frequency(Workspace.of_sessions(spark, folder).plog), MINING)


@query(
    "start_end_counts",
    with_(
        q.PL,
        "SELECT 'start' AS side, activity, count(*) AS cases FROM pl WHERE pos = 0 GROUP BY 2 UNION ALL "
        "SELECT 'end', activity, count(*) FROM pl WHERE next_activity IS NULL GROUP BY 2",
    ),
)
def start_end_counts(spark, folder):
    return mining.start_end_counts(Workspace.of_sessions(spark, folder).plog)


@query("dfg_frequency", with_(q.PL, "SELECT source, target, count(*) AS frequency FROM edges GROUP BY 1, 2"))
def dfg_frequency(spark, folder):
    return mining.dfg_frequency(Workspace.of_sessions(spark, folder).plog)


# the raw event log: one case per user, event types as activities
_USER_EDGES = """WITH e AS (SELECT event_type AS source, lead(event_type) OVER w AS target,
  date_diff('microsecond', ts, lead(ts) OVER w) / 3600000000.0 AS hours FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT source, target, count(*) AS n, round(avg(hours), 6) AS mean, round(median(hours), 6) AS median,
  round(min(hours), 6) AS min, round(max(hours), 6) AS max, round(stddev_samp(hours), 6) AS stddev, round(sum(hours), 4) AS sum
FROM e WHERE target IS NOT NULL GROUP BY 1, 2"""


def user_log(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").alias("event_at"), "event_id"
    )
    scale = table_scale(spark, folder, "events")
    return mining.simple_log(rows, scale), scale


@query("dfg_performance", _USER_EDGES)
def dfg_performance(spark, folder):
    log, scale = user_log(spark, folder)
    got = mining.dfg_performance(log, scale)
    return tidy(got.withColumn("sum", F.round("sum", 4))).select(
        "source", "target", "n", "mean", "median", "min", "max", "stddev", "sum"
    )


@query(
    "dfg_reconcile",
    with_(q.PL, "SELECT count(*) AS edges, CAST(0 AS BIGINT) AS differing FROM (SELECT DISTINCT source, target FROM edges)"),
)
def dfg_reconcile(spark, folder):
    log = Workspace.of_sessions(spark, folder).plog
    return mining.dfg_reconcile(mining.dfg_frequency(log), mining.dfg_by_self_lookup(log))


@query(
    "dfg_conversations",
    """SELECT source, target, count(*) AS frequency FROM (SELECT role AS source,
  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations) WHERE target IS NOT NULL GROUP BY 1, 2""",
)
def dfg_conversations(spark, folder):
    from ..functions.ordered import scan
    from ..sources.tables import turn_log

    rows = scan(
        turn_log(spark, folder), ["case_id"], ["pos"], table_scale(spark, folder, "conversations"), following={"target": F.col("activity")}
    )
    return (
        rows.where(F.col("target").isNotNull())
        .groupBy(F.col("activity").alias("source"), "target")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


@query(
    "self_loops",
    with_(
        q.PL,
        """SELECT 'self-transition-' || substr(sha256(source || chr(31) || source), 1, 12) AS loop_id, source AS activity,
  count(*) AS occurrences, count(DISTINCT case_id) AS cases, round(median(hours), 6) AS median_hours
FROM edges WHERE source = target GROUP BY source""",
    ),
)
def self_loops(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    got = mining.self_loops(ws.plog, ws.scale)
    return tidy(got.select("loop_id", F.col("source").alias("activity"), "occurrences", "cases", "median_hours"))


@query(
    "two_step_loops",
    with_(
        q.PL,
        f"""SELECT 'two-step-transition-' || substr(sha256(source || chr(31) || target), 1, 12) AS loop_id, source, target AS via,
  count(*) AS occurrences, count(DISTINCT case_id) AS cases, round(median({q.hours('event_at', 'third_at')}), 6) AS median_hours
FROM (SELECT *, lead(next_activity) OVER (PARTITION BY case_id ORDER BY pos) AS third,
  lead(next_at) OVER (PARTITION BY case_id ORDER BY pos) AS third_at FROM pl
  ) p, LATERAL (SELECT activity AS source, next_activity AS target) WHERE third = activity AND next_activity <> activity
GROUP BY source, target""",
    ),
)
def two_step_loops(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return tidy(mining.two_step_loops(ws.plog, ws.scale).drop("loop_type"))


# --- variants ---------------------------------------------------------------------
VARIANT_TABLE = (
    q.CM
    + q.PL_FROM_TL
    + q.VARIANTS_FROM_PL
    + """,
vt AS (
  SELECT variant_id, count(*) AS cases, count(*) / (SELECT count(*) FROM cv) AS share, max(length) AS length,
    CASE WHEN count(*) <= 2 THEN 'rare' ELSE 'common' END AS class,
    avg(manual_touches) AS mean_manual_touches, avg(handoffs) AS mean_handoffs, avg(rework_count) AS mean_rework,
    avg(CAST(first_pass_complete AS INT)) AS first_pass_rate,
    median(case_duration_hours) FILTER (WHERE case_duration_hours_status = 'calculated') AS duration_median,
    quantile_cont(case_duration_hours, 0.9) FILTER (WHERE case_duration_hours_status = 'calculated') AS duration_p90
  FROM cv LEFT JOIN cm USING (case_id) GROUP BY 1
)"""
)
_VT = ("share", "mean_manual_touches", "mean_handoffs", "mean_rework", "first_pass_rate", "duration_median", "duration_p90")


@query(
    "variants",
    with_(VARIANT_TABLE, "SELECT variant_id, cases, length, class, " + ", ".join(f"round({c}, 6) AS {c}" for c in _VT) + " FROM vt"),
)
def variants_(spark, folder):
    return tidy(Workspace.of_sessions(spark, folder).variants.select("variant_id", "cases", "length", "class", *_VT))


@query("variant_class", with_(q.VAR, "SELECT class, count(*) AS variants, CAST(sum(cases) AS BIGINT) AS cases FROM cores GROUP BY 1"))
def variant_class(spark, folder):
    cores = Workspace.of_sessions(spark, folder).cores
    return cores.groupBy("class").agg(F.count(F.lit(1)).alias("variants"), F.sum("cases").alias("cases"))


_MARKER_SQL = "list_filter([" + ", ".join(
    [f"CASE WHEN list_contains(acts, '{a}') THEN '{m}' END" for a, m in variants.MARKERS.items()]
    + [
        "CASE WHEN NOT list_has_any(acts, " + q._list(vocab.TERMINAL_ACTIVITIES) + ") THEN 'open_or_stuck' END",
        "CASE WHEN len(list_distinct(acts)) < len(acts) THEN 'repeated_activity' END",
    ]
) + "], lambda x: x IS NOT NULL)"


@query("variant_markers", with_(q.VAR, f"SELECT variant_id, array_to_string({_MARKER_SQL}, ',') AS markers FROM cores"))
def variant_markers(spark, folder):
    return Workspace.of_sessions(spark, folder).markers.select("variant_id", joined("markers").alias("markers"))


@query(
    "variant_profile",
    with_(
        q.VAR,
        "SELECT variant_id, string_agg(status || ':' || n, ',' ORDER BY status) AS outcomes FROM "
        "(SELECT variant_id, c.status, count(*) AS n FROM cv JOIN cases c USING (case_id) GROUP BY 1, 2) GROUP BY 1",
    ),
)
def variant_profile(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    got = variants.variant_profile(ws.case_variants, ws.wide)
    text = F.transform(F.map_entries("outcomes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return got.select("variant_id", F.concat_ws(",", F.array_sort(text)).alias("outcomes"))


@query(
    "variant_support",
    with_(
        q.VAR,
        """SELECT variant_id, string_agg(case_id, ',' ORDER BY case_id) AS case_ids FROM (
  SELECT variant_id, case_id, row_number() OVER (PARTITION BY variant_id ORDER BY case_id) AS rn FROM cv) WHERE rn <= 10 GROUP BY 1""",
    ),
)
def variant_support(spark, folder):
    got = variants.variant_support(Workspace.of_sessions(spark, folder).case_variants)
    return got.select("variant_id", joined("representative_case_ids").alias("case_ids"))


@query("topk_variants", with_(q.VAR, "SELECT variant_id, cases FROM cores ORDER BY cases DESC, variant_id LIMIT 20"))
def topk_variants(spark, folder):
    return variants.topk_variants(Workspace.of_sessions(spark, folder).cores, 20).select("variant_id", "cases")


@query(
    "cumulative_coverage",
    with_(
        q.VAR,
        """SELECT variant_id, cases, row_number() OVER w AS rank, round(sum(cases) OVER w / (SELECT sum(cases) FROM cores), 6)
  AS coverage FROM cores WINDOW w AS (ORDER BY cases DESC, variant_id)""",
    ),
)
def cumulative_coverage(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    got = tidy(variants.cumulative_coverage(ws.cores, ws.scale))
    return got.withColumn("rank", F.col("rank").cast("long"))


def complexity_sql(traces: str, log: str = "pl", pairs: str = "edges") -> str:
    """All log-level measures of a log whose variants are `cv`, `cores` with a suffix; rework and hand-offs of all cases."""
    cv, cores, tot, ranked = (f"{name}{traces}" for name in ("cv", "cores", "tot", "ranked"))
    return f"""SELECT 'distinct_activity_count' AS measure, CAST(count(DISTINCT activity) AS DOUBLE) AS number FROM {log}
UNION ALL SELECT 'distinct_transition_count', count(DISTINCT (source, target)) FROM {pairs}
UNION ALL SELECT 'distinct_variant_count', count(*) FROM {cores}
UNION ALL SELECT 'top_1_variant_coverage', sum(cases) FILTER (WHERE r <= 1) / any_value(t) FROM {ranked}, {tot}
UNION ALL SELECT 'top_5_variant_coverage', sum(cases) FILTER (WHERE r <= 5) / any_value(t) FROM {ranked}, {tot}
UNION ALL SELECT 'top_10_variant_coverage', sum(cases) FILTER (WHERE r <= 10) / any_value(t) FROM {ranked}, {tot}
UNION ALL SELECT 'long_tail_variant_count', count(*) FILTER (WHERE class = 'rare') FROM {cores}
UNION ALL SELECT 'mean_activities_per_case', avg(length) FROM {cv}
UNION ALL SELECT 'median_activities_per_case', median(length) FROM {cv}
UNION ALL SELECT 'maximum_activities_per_case', max(length) FROM {cv}
UNION ALL SELECT 'loop_case_rate', count(*) FILTER (WHERE len(list_distinct(acts)) < len(acts)) / count(*) FROM {cv}
UNION ALL SELECT 'rework_case_rate', count(*) FILTER (WHERE rework_count > 0) / (SELECT t FROM {tot}) FROM cm
UNION ALL SELECT 'handoff_case_rate', count(*) FILTER (WHERE handoffs > 0) / (SELECT t FROM {tot}) FROM cm
UNION ALL SELECT 'terminal_path_diversity', count(DISTINCT activity) FROM {log} WHERE next_activity IS NULL
UNION ALL SELECT 'variant_entropy_bits', -sum(cases / t * log2(cases / t)) FROM {cores}, {tot}"""


def ranks_sql(traces: str = "") -> str:
    return (
        f", tot{traces} AS (SELECT count(*) AS t FROM cv{traces}), "
        f"ranked{traces} AS (SELECT cases, row_number() OVER (ORDER BY cases DESC, variant_id) AS r FROM cores{traces})"
    )


@query(
    "complexity",
    with_(
        q.CM + q.PL_FROM_TL + q.VARIANTS_FROM_PL + ranks_sql(), f"SELECT measure, round(number, 6) AS number FROM ({complexity_sql('')})"
    ),
)
def complexity(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return tidy(variants.complexity(ws.plog, ws.case_variants, ws.cores, ws.wide, ws.scale))


# --- conformance ------------------------------------------------------------------
# a small lenient model over raw event types, checked step by step in SQL
SHOP = ReferenceModel(
    "shop-v1",
    (
        ("idle", "looking", "view"),
        ("looking", "looking", "click"),
        ("looking", "known", "signup"),
        ("looking", "bought", "purchase"),
        ("known", "bought", "purchase"),
        ("bought", "looking", "view"),
        ("known", "known", "click"),
    ),
    "idle",
    "bought",
    terminals=("purchase",),
)


RAW_SESSIONS = q.EV.strip() + """,
rs AS (SELECT user_id || '-' || session_no AS case_id, ts AS event_at, event_id, raw_type FROM typed)"""


def replay_sql(model: ReferenceModel) -> str:
    """CTEs `walk` and `scored`: one label of `u` (case_id, p, act) at a time, places as columns."""
    states = tuple(f"s_{s}" for s in model.states)
    start, end = f"s_{model.start}", f"s_{model.end}"

    def fire(name: str) -> dict[str, str]:
        options = [(f"s_{a}", f"s_{b}") for a, b, step in model.steps if step == name]
        tests = [f"{a} > 0" for a, _ in options]
        moves = {}
        for state in states:
            cases = []
            for test, (a, b) in zip(tests, options):
                change = (state == b) - (state == a)
                cases.append(f"WHEN {test} THEN {state} + ({change})")
            first = options[0]
            moves[state] = f"CASE {' '.join(cases)} ELSE {state} + {int(state == first[1])} END"
        moves["missing"] = f"CASE WHEN {' OR '.join(tests)} THEN missing ELSE missing + 1 END"
        return moves

    columns = {}
    for column in (*states, "missing"):
        columns[column] = (
            "CASE u.act " + " ".join(f"WHEN '{n}' THEN {fire(n)[column]}" for n in model.labels) + f" ELSE {column} END"
        )
    known = q.quoted(model.labels)
    return f"""walk AS (
  SELECT case_id, CAST(0 AS BIGINT) AS p, {', '.join(f"{int(s == start)} AS {s}" for s in states)}, 0 AS missing, 0 AS fired
  FROM (SELECT DISTINCT case_id FROM u)
  UNION ALL
  SELECT w.case_id, u.p, {', '.join(columns[s] for s in states)}, {columns['missing']},
    fired + CASE WHEN u.act IN {known} THEN 1 ELSE 0 END
  FROM walk w JOIN u ON u.case_id = w.case_id AND u.p = w.p + 1
),
final AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC) AS r FROM walk),
scored AS (
  SELECT case_id, missing + CASE WHEN {end} > 0 THEN 0 ELSE 1 END AS missing,
    {' + '.join(states)} - CASE WHEN {end} > 0 THEN 1 ELSE 0 END AS remaining, fired + 1 AS moved FROM final WHERE r = 1
),
fit AS (SELECT case_id, CAST(missing AS BIGINT) AS missing, CAST(remaining AS BIGINT) AS remaining,
  0.5 * (1 - missing / moved) + 0.5 * (1 - remaining / moved) AS fitness FROM scored)"""


_FIT = "SELECT case_id, missing, remaining, round(fitness, 6) AS fitness FROM fit"


@query(
    "token_replay",
    f"""WITH RECURSIVE {RAW_SESSIONS},
u AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY event_at, event_id) AS p, raw_type AS act FROM rs),
{replay_sql(SHOP)} {_FIT}""",
)
def token_replay(spark, folder):
    from ..functions.ordered import scan
    from ..sources.tables import sessionise

    scale = table_scale(spark, folder, "events")
    rows = sessionise(table(spark, folder, "events"), "user_id", "ts", "event_id", 12.0, scale).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("session_no").cast("string")).alias("case_id"),
        F.col("event_type").alias("activity"),
        F.col("ts").alias("event_at"),
        "event_id",
    )
    log = scan(rows, ["case_id"], ["event_at", "event_id"], scale, position="pos")
    cases = variants.case_variants(log, MiningSpec())
    cores = variants.variant_cores(cases, MiningSpec())
    replay = conformance.token_replay(variants.variant_events(log, cores), SHOP)
    return tidy(cases.join(replay, "variant_id").select("case_id", "missing", "remaining", "fitness"))


GOVERNED = (
    "RECURSIVE "
    + q.VAR
    + ",\nu AS (SELECT case_id, pos + 1 AS p, activity AS act FROM pl),\n"
    + replay_sql(governed_model())
)


@query("token_replay_governed", with_(GOVERNED, _FIT))
def token_replay_governed(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    got = ws.case_variants.join(ws.governed_replay, "variant_id")
    return tidy(got.select("case_id", "missing", "remaining", "fitness"))


_STRICT = q._list(vocab.STRICT_SEQUENCE)
STRICT_DEV = (
    q.VAR
    + f""",
st AS (SELECT variant_id, unnest(acts) AS activity, generate_subscripts(acts, 1) - 1 AS pos FROM cores),
known AS (SELECT variant_id, pos, activity, list_position({_STRICT}, activity) AS idx FROM st),
lasts AS (
  SELECT variant_id, acts[-1] AS last, list_filter(acts, lambda x: list_contains({q._list(vocab.TERMINAL_ACTIVITIES)}, x)) AS ends
  FROM cores
),
sdev AS (
  SELECT variant_id, 'missing_activity' AS category, a AS activity, CAST(NULL AS BIGINT) AS pos
  FROM cores, unnest({_STRICT}) AS s(a) WHERE NOT list_contains(acts, a)
  UNION ALL SELECT variant_id, 'unexpected_activity', activity, pos FROM known WHERE coalesce(idx, 0) = 0
  UNION ALL SELECT variant_id, 'activity_repeated', activity, NULL FROM known WHERE idx > 0
    GROUP BY variant_id, activity HAVING count(*) > 1
  UNION ALL SELECT DISTINCT variant_id, 'unexpected_order', NULL, NULL FROM
    (SELECT variant_id, idx, lag(idx) OVER (PARTITION BY variant_id ORDER BY pos) AS before FROM known WHERE idx > 0)
    WHERE before > idx
  UNION ALL SELECT variant_id, 'missing_terminal_event', NULL, NULL FROM lasts WHERE len(ends) = 0
  UNION ALL SELECT variant_id, 'early_termination', NULL, NULL FROM lasts
    WHERE len(ends) > 0 AND NOT list_contains({q._list(vocab.TERMINAL_ACTIVITIES)}, last)
  UNION ALL SELECT variant_id, 'unexpected_terminal_event', ends[-1], NULL FROM lasts
    WHERE len(ends) > 0 AND ends[-1] <> 'Referral completed'
)"""
)


@query("strict_deviations", with_(STRICT_DEV, "SELECT variant_id, category, activity, pos FROM sdev"))
def strict_deviations(spark, folder):
    return Workspace.of_sessions(spark, folder, store=True).strict_deviations


# deviations that need no replay
GOV_DEV_FROM_STRICT = """,
cnt AS (SELECT variant_id, activity, count(*) AS n FROM st GROUP BY 1, 2),
gdev AS (
  SELECT variant_id, 'unexpected_recategorisation' AS category, activity FROM cnt WHERE activity = 'Referral recategorised' AND n > 1
  UNION ALL SELECT variant_id, 'unexpected_reassignment', activity FROM cnt WHERE activity = 'Clinical team reassigned' AND n > 1
  UNION ALL SELECT variant_id, 'excessive_loop', activity FROM cnt WHERE n > 1 AND activity IN
    ('Referral recategorised', 'Clinical team reassigned', 'Missing information requested')
  UNION ALL SELECT variant_id, 'scheduling_retry', activity FROM cnt WHERE activity = 'Scheduling failed'
  UNION ALL SELECT variant_id, category, activity FROM sdev WHERE category IN ('missing_terminal_event', 'early_termination')
)"""


def _renamed(sql: str, suffix: str) -> str:
    """The replay's tables under other names, for a second model in one statement."""
    import re

    return re.sub(r"\b(walk|final|scored|fit)\b(?!ness)", rf"\1_{suffix}", sql)


# all deviations: of a variant that replays with faults and without another deviation, the order is unexpected
GOV_DEV_ALL = (
    GOV_DEV_FROM_STRICT.replace("gdev AS (", "gdev_plain AS (")
    + """,
u AS (SELECT case_id, pos + 1 AS p, activity AS act FROM pl WHERE case_id IN (SELECT representative FROM cores)),
"""
    + _renamed(replay_sql(governed_model()), "gov")
    + f""",
vfit AS (SELECT variant_id, fitness FROM fit_gov JOIN cores ON representative = case_id),
gdev_known AS (
  SELECT * FROM gdev_plain
  UNION ALL SELECT variant_id, 'unsupported_activity', activity FROM st WHERE activity NOT IN {q.quoted(governed_model().labels)}
),
gdev AS (
  SELECT * FROM gdev_known
  UNION ALL SELECT variant_id, 'unexpected_order', NULL FROM vfit WHERE fitness < 1 AND variant_id NOT IN (SELECT variant_id FROM gdev_known)
)"""
)


@query(
    "governed_deviations",
    with_("RECURSIVE " + STRICT_DEV + GOV_DEV_ALL, "SELECT variant_id, category, activity FROM gdev"),
)
def governed_deviations(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    return ws.governed_deviations.select("variant_id", "category", "activity")


@query(
    "variant_conformance",
    with_(
        GOVERNED.replace(q.VAR, STRICT_DEV + GOV_DEV_FROM_STRICT) + ",\n" + _renamed(replay_sql(strict_model()), "strict"),
        f"""SELECT cv.variant_id, count(*) AS cases, round(avg(s.fitness), 6) AS strict_fitness,
  avg(CASE WHEN s.fitness = 1 AND cv.variant_id NOT IN (SELECT variant_id FROM sdev) THEN 1.0 ELSE 0.0 END) AS strict_full_rate,
  round(avg(g.fitness), 6) AS governed_fitness, avg(CASE WHEN g.fitness = 1 AND cv.variant_id NOT IN
    (SELECT variant_id FROM gdev WHERE category <> 'scheduling_retry') THEN 1.0 ELSE 0.0 END) AS governed_full_rate
FROM cv JOIN fit g USING (case_id) JOIN fit_strict s USING (case_id) GROUP BY 1""",
    ),
)
def variant_conformance(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    return tidy(conformance.variant_conformance(ws.cores, ws.strict_status, ws.governed_status))


@query(
    "deviation_counts",
    with_(
        STRICT_DEV,
        "SELECT category, CAST(sum(cases) AS BIGINT) AS deviations FROM sdev JOIN cores USING (variant_id) GROUP BY 1",
    ),
)
def deviation_counts(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    return conformance.deviation_counts(ws.cores, ws.strict_deviations)


# strict conformance: full iff the sequence is the chain itself
@query(
    "conformance_status",
    with_(
        q.VAR,
        f"SELECT variant_id, acts = {_STRICT} AS fits FROM cores",
    ),
)
def conformance_status(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    return ws.strict_status.select("variant_id", (F.col("conformance") == "fully_conforming").alias("fits"))


_GROUPS = (("overall", "'all'"), ("status", "status"), ("referral_source", "referral_source"), ("service_line", "service_line"))


@query(
    "conformance_summary",
    with_(
        "RECURSIVE "
        + STRICT_DEV
        + GOV_DEV_FROM_STRICT
        + GOVERNED[len("RECURSIVE " + q.VAR):]
        + """,
bad AS (SELECT DISTINCT variant_id FROM gdev WHERE category <> 'scheduling_retry'),
rg AS (SELECT f.fitness, f.fitness = 1 AND cv.variant_id NOT IN (SELECT variant_id FROM bad) AS fits, c.status, c.referral_source,
  c.service_line FROM fit f JOIN cv USING (case_id) JOIN cases c USING (case_id))""",
        " UNION ALL ".join(
            f"""SELECT '{d}' AS dimension, {v} AS value, count(*) AS cases, count(fitness) AS available, round(avg(fitness), 6) AS mean_fitness,
  round(median(fitness), 6) AS median_fitness, round(avg(CAST(fits AS INT)), 6) AS full_rate FROM rg GROUP BY 2"""
            for d, v in _GROUPS
        ),
    ),
)
def conformance_summary(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    got = conformance.conformance_summary(ws.results(ws.governed_status), ws.scale)
    return tidy(
        got.select("dimension", "value", "cases", "available", "mean_fitness", "median_fitness", "full_rate")
    )


@query(
    "conformance_summary_strict",
    with_(
        q.VAR
        + f""",
r AS (SELECT cv.case_id, acts = {_STRICT} AS fits, c.status, c.referral_source, c.service_line FROM cv JOIN cases c USING (case_id))""",
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {v} AS value, count(*) AS cases, round(avg(CAST(fits AS INT)), 6) AS full_rate FROM r GROUP BY 2"
            for d, v in (
                ("overall", "'all'"),
                ("status", "status"),
                ("referral_source", "referral_source"),
                ("service_line", "service_line"),
            )
        ),
    ),
)
def conformance_summary_strict(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    got = conformance.conformance_summary(ws.results(ws.strict_status), ws.scale)
    return tidy(got.select("dimension", "value", "cases", "full_rate"))


@query(
    "case_process_result",
    with_(
        q.VAR,
        """SELECT cv.case_id, variant_id, cv.length, p.pos,
  'transition-' || substr(sha256(activity || chr(31) || next_activity), 1, 12) AS edge_id
FROM cv JOIN pl p USING (case_id) WHERE next_activity IS NOT NULL""",
    ),
)
def case_process_result(spark, folder):
    from ..functions.ids import transition_id

    ws = Workspace.of_sessions(spark, folder)
    pairs = mining.edges(ws.plog).select(
        "case_id", F.col("pos").cast("long").alias("pos"), transition_id(F.col("source"), F.col("target")).alias("edge_id")
    )
    return ws.case_variants.join(pairs, "case_id").select("case_id", "variant_id", "length", "pos", "edge_id")


# --- graph and candidates -----------------------------------------------------------
@query(
    "graph_tables",
    with_(
        STRICT_DEV,
        f"""SELECT 'activity-' || substr(sha256(activity), 1, 12) AS node_id, activity, count(*) AS frequency,
  count(DISTINCT case_id) AS cases, bool_or(pos = 0) AS is_start,
  activity IN {q.quoted(vocab.TERMINAL_ACTIVITIES)} AS is_terminal, round(avg(CAST(manual AS INT)), 6) AS manual_rate,
  round(avg(pos), 6) AS mean_position,
  coalesce((SELECT CAST(sum(c.cases) AS BIGINT) FROM sdev s JOIN cores c USING (variant_id) WHERE s.activity = pl.activity), 0) AS deviations
FROM pl GROUP BY activity""",
    ),
)
def graph_tables(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    nodes = mining.graph_nodes(
        mining.activity_stats(ws.plog),
        mining.start_end_counts(ws.plog),
        conformance.activity_deviations(ws.cores, ws.strict_deviations),
        ws.mspec,
    )
    return tidy(nodes.drop("rework_cases"))


@query(
    "serving_tables",
    with_(
        q.PL + TRANSITIONS_FROM_PL,
        "SELECT source, target, frequency, round(hours_median, 6) AS hours_median, round(handoff_rate, 6) AS handoff_rate "
        "FROM ts ORDER BY frequency DESC, source, target LIMIT 12",
    ),
)
def serving_tables(spark, folder):
    # the busiest edges of the whole log for display
    stats = Workspace.of_sessions(spark, folder).transitions
    top = stats.orderBy(F.desc("frequency"), "source", "target").limit(12)
    return tidy(top.select("source", "target", "frequency", "hours_median", "handoff_rate"))


_CAND_COLUMNS = (
    "candidate_id", "candidate_type", "subject", "dimension", "value", "cases", "frequency", "comparison", "observed",
    "relative_difference", "median_hours", "materiality",
)
_CAND_ROUND = ("comparison", "observed", "relative_difference", "median_hours")
FEATURES_FROM_PL = f""",
feat AS (
  SELECT case_id, any_value(referral_source) AS referral_source, any_value(service_line) AS service_line,
    {q.hours('min(event_at)', 'max(event_at)')} AS elapsed,
    CASE WHEN bool_or(activity = 'Missing information requested') THEN 1 ELSE 0 END AS missing,
    count(*) FILTER (WHERE activity = 'Scheduling failed') AS failed,
    count(*) FILTER (WHERE activity = 'Clinical team reassigned') AS reassigned
  FROM pl GROUP BY 1
),
flong AS (
  SELECT case_id, elapsed, 'referral_source_rework_path' AS candidate_type, 'Missing information requested' AS subject,
    'referral_source' AS dimension, referral_source AS value, missing AS hits FROM feat
  UNION ALL SELECT case_id, elapsed, 'service_line_scheduling_retries', 'Scheduling failed', 'service_line', service_line, failed FROM feat
  UNION ALL SELECT case_id, elapsed, 'service_line_reassignment', 'Clinical team reassigned', 'service_line', service_line, reassigned FROM feat
),
frate AS (
  SELECT candidate_type, subject, dimension, value, count(*) AS cases, CAST(sum(hits) AS BIGINT) AS frequency,
    any_value(base) AS comparison, avg(CAST(hits > 0 AS INT)) AS observed, median(elapsed) AS median_hours
  FROM flong JOIN (SELECT candidate_type, avg(CAST(hits > 0 AS INT)) AS base FROM flong GROUP BY 1) USING (candidate_type)
  GROUP BY 1, 2, 3, 4
)"""


def _finish_sql(inner: str) -> str:
    rel = "CASE WHEN comparison <> 0 THEN (observed - comparison) / comparison END"
    return f"""SELECT 'candidate-' || substr(sha256(candidate_type || chr(31) || subject || chr(31) || coalesce(value, '')), 1, 16)
  AS candidate_id, candidate_type, subject, dimension, value, cases, frequency, round(comparison, 6) AS comparison,
  round(observed, 6) AS observed, round({rel}, 6) AS relative_difference, round(median_hours, 6) AS median_hours,
  CASE WHEN {rel} >= 0.5 THEN 'strong' WHEN {rel} >= 0.2 THEN 'material' ELSE 'small' END AS materiality FROM ({inner})"""


def _candidates(df):
    return tidy(df.select(*_CAND_COLUMNS))


# the logs here are nearly uniform: lower thresholds than the defaults let the check see rows
@query(
    "cohort_candidates",
    with_(
        q.PL + FEATURES_FROM_PL,
        _finish_sql(
            "SELECT * FROM frate WHERE cases >= 20 AND comparison > 0 AND (observed - comparison) / comparison >= 0.02"
        ),
    ),
)
def cohort_candidates(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return _candidates(bn.cohort_candidates(ws.plog, ws.mspec, ws.scale, least=0.02))


@query(
    "cohort_feature_rates",
    with_(
        q.PL + FEATURES_FROM_PL,
        "SELECT candidate_type, value, count(*) AS cases, CAST(sum(hits) AS BIGINT) AS hits, round(avg(elapsed), 6) AS mean_elapsed "
        "FROM flong GROUP BY 1, 2",
    ),
)
def cohort_feature_rates(spark, folder):
    feats = bn.trace_features(Workspace.of_sessions(spark, folder).plog)
    entries = [
        F.struct(
            F.lit(kind).alias("candidate_type"),
            F.col(dim).alias("value"),
            (F.least(F.col(kind), F.lit(1)) if dim == "referral_source" else F.col(kind)).cast("long").alias("hits"),
        )
        for kind, _, dim in bn.FEATURE_RULES
    ]
    got = feats.select("elapsed", F.inline(F.array(*entries))).groupBy("candidate_type", "value")
    return tidy(
        got.agg(F.count(F.lit(1)).alias("cases"), F.sum("hits").alias("hits"), F.avg("elapsed").alias("mean_elapsed"))
    )


@query(
    "assignment_candidates",
    with_(
        q.PL
        + """,
del AS (SELECT * FROM edges WHERE source IN ('Referral categorised', 'Referral recategorised') AND target = 'Clinical team assigned')""",
        _finish_sql(
            """SELECT 'service_line_assignment_delay' AS candidate_type, 'Referral categorised -> Clinical team assigned' AS subject,
  'service_line' AS dimension, service_line AS value, any_value(n) AS cases, count(*) AS frequency,
  (SELECT median(hours) FROM del) AS comparison, median(hours) AS observed, median(hours) AS median_hours
  FROM del JOIN (SELECT service_line, count(DISTINCT case_id) AS n FROM pl GROUP BY 1) USING (service_line) GROUP BY service_line
  HAVING any_value(n) >= 20 AND median(hours) >= 1.2 * (SELECT median(hours) FROM del)"""
        ),
    ),
)
def assignment_candidates(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return _candidates(bn.assignment_candidates(ws.plog, ws.mspec, ws.scale))


@query(
    "slow_transitions",
    with_(
        q.PL + TRANSITIONS_FROM_PL + ", base AS (SELECT median(hours_median) AS b FROM ts WHERE frequency >= 5)",
        _finish_sql(
            """SELECT 'high_frequency_slow_transition' AS candidate_type, source || ' -> ' || target AS subject,
  CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS value, cases, frequency, b AS comparison,
  hours_median AS observed, hours_median AS median_hours FROM ts, base WHERE frequency >= 5 AND hours_median >= b * 1.5"""
        ),
    ),
)
def slow_transitions(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return _candidates(bn.slow_transitions(ws.transitions, ws.mspec, ws.scale))


@query(
    "slow_variants",
    with_(
        VARIANT_TABLE + ", base AS (SELECT median(duration_median) AS b FROM vt)",
        _finish_sql(
            """SELECT 'variant_elevated_duration' AS candidate_type, variant_id AS subject, CAST(NULL AS VARCHAR) AS dimension,
  CAST(NULL AS VARCHAR) AS value, cases, cases AS frequency, b AS comparison, duration_median AS observed,
  duration_median AS median_hours FROM vt, base WHERE cases >= 2 AND duration_median >= b * 0.5"""
        ),
    ),
)
def slow_variants(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return _candidates(bn.slow_variants(ws.variants, ws.mspec, ws.scale, factor=0.5))


@query(
    "nonconforming_duration",
    with_(
        q.VAR + FEATURES_FROM_PL,
        f"""SELECT count(*) AS cases, round(median(elapsed), 6) AS median_hours, 'small' AS materiality
FROM feat JOIN cv USING (case_id) WHERE acts <> {_STRICT} HAVING count(*) >= 20""",
    ),
)
def nonconforming_duration(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    results = conformance.case_conformance(ws.case_variants, ws.strict_status)
    got = bn.nonconforming_duration(ws.plog, results, ws.mspec, ws.scale)
    return tidy(got.select("cases", "median_hours", "materiality"))


@query(
    "materiality",
    with_(
        q.PL + TRANSITIONS_FROM_PL + ", base AS (SELECT median(hours_median) AS b FROM ts)",
        """SELECT source, target, CASE WHEN (hours_median - b) / b >= 0.5 THEN 'strong' WHEN (hours_median - b) / b >= 0.2
  THEN 'material' ELSE 'small' END AS materiality FROM ts, base""",
    ),
)
def materiality(spark, folder):
    stats = Workspace.of_sessions(spark, folder).transitions
    base = stats.agg(F.median("hours_median").alias("b"))
    rel = (F.col("hours_median") - F.col("b")) / F.col("b")
    return stats.crossJoin(F.broadcast(base)).select("source", "target", bn.materiality(rel).alias("materiality"))


@query(
    "join_findings_candidates",
    with_(
        FINDINGS
        + q.PL_FROM_TL
        + FEATURES_FROM_PL
        + """,
cand AS (SELECT 'candidate-' || substr(sha256(candidate_type || chr(31) || subject || chr(31) || value), 1, 16) AS candidate_id, *
  FROM frate WHERE cases >= 20 AND comparison > 0 AND (observed - comparison) / comparison >= 0.2),
pairs(finding_type, candidate_type) AS (VALUES """
        + ", ".join(f"('{f}', '{c}')" for f, cs in bn.SUPPORTING_TYPES.items() for c in cs)
        + ")",
        """SELECT finding_id, string_agg(DISTINCT candidate_id, ',' ORDER BY candidate_id) AS candidate_ids,
  count(candidate_id) > 0 AS supported, coalesce(max(c.cases), 0) AS sample_size
FROM found f LEFT JOIN pairs p USING (finding_type) LEFT JOIN cand c
  ON c.candidate_type = p.candidate_type AND c.dimension = f.dimension AND c.value = f.value GROUP BY 1""",
    ),
)
def join_findings_candidates(spark, folder):
    ws = Workspace.of_sessions(spark, folder, store=True)
    cands = bn.cohort_candidates(ws.plog, ws.mspec, ws.scale)
    got = bn.reconcile(ws.findings, cands, bn.supporting_types(spark))
    ids = F.when(F.size("candidate_ids") > 0, joined("candidate_ids"))
    return got.select("finding_id", ids.alias("candidate_ids"), "supported", "sample_size")


@query(
    "run_summary",
    with_(
        VALUES,
        """SELECT dimension, value, round(max(observed) FILTER (WHERE metric = 'handoffs'), 6) AS handoffs,
  round(max(observed) FILTER (WHERE metric = 'completion_rate'), 6) AS completion_rate,
  round(max(observed) FILTER (WHERE metric = 'waiting_time_business_hours'), 6) AS waiting_time_business_hours
FROM vals GROUP BY 1, 2""",
    ),
)
def run_summary(spark, folder):
    from ..operators.whatif import run_summary as summary

    values = Workspace.of_sessions(spark, folder).values
    return tidy(summary(values, ("handoffs", "completion_rate", "waiting_time_business_hours")))
