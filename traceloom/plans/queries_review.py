"""Registered queries: altered logs, review workload, audit chains, lineage, files."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import cohorts, lineage, quality, review, variants, whatif
from ..operators.metrics import case_metrics
from ..session import pin, shared_folder
from ..sources import files, sinks
from ..sources import snapshots as sn
from ..sources.tables import session_log, table, table_scale
from ..spec import ContractSpec, ReviewSpec
from . import queries_intake as qi
from . import queries_mining as m
from . import sql as q
from .registry import CHECKS, joined, query, tidy
from .sql import with_
from .workspace import BASELINE, MINING, Workspace

SEED, VERSION, SHARE, REVIEW_H, SYSTEM_H = "seed-7", "v1", 0.7, 0.5, 0.1
COHORT = ("referral_source", "gp_practice")
RUN = "run-1"
REVIEW = ReviewSpec()

# --- altered logs --------------------------------------------------------------
# sessions by a gap of a day instead of half a day: longer cases, more of them eligible
GAP = 24.0
LONG_CASES = q.CASES.replace("43200000000", "86400000000")
ELIGIBLE = (
    LONG_CASES
    + f""",
elig AS (
  SELECT case_id, array_to_string(list_filter([
    CASE WHEN referral_source <> 'gp_practice' THEN 'outside_cohort' END,
    CASE WHEN schema_version <> 1 OR bad THEN 'unsupported_schema_version' END,
    CASE WHEN r_at IS NULL THEN 'missing_received_event' END,
    CASE WHEN c_at IS NULL THEN 'missing_check_event' END,
    CASE WHEN c_at < r_at THEN 'unsupported_event_sequence' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM cases LEFT JOIN (SELECT case_id, bool_or(schema_version <> 1) AS bad,
    min(event_at) FILTER (WHERE event_type = '{q._IS['received']}') AS r_at,
    min(event_at) FILTER (WHERE event_type = '{q._IS['check']}') AS c_at FROM ev GROUP BY 1) USING (case_id)
),
draw AS (
  SELECT case_id, CAST(CAST('0x' || substr(sha256('{SEED}' || chr(31) || case_id || chr(31) || '{VERSION}'), 1, 15) AS BIGINT) AS DOUBLE)
    / 1152921504606846976.0 AS draw FROM cases
),
app AS (
  SELECT case_id FROM elig JOIN draw USING (case_id) WHERE reasons = '' AND draw < {SHARE}
    AND case_id IN (SELECT case_id FROM ev WHERE event_type = '{q._IS['request']}')
)"""
)
_ORD = "(event_at, event_id)"
OVERLAY = (
    ELIGIBLE
    + f""",
anch AS (
  SELECT case_id, min(event_at) FILTER (WHERE event_type = '{q._IS['received']}') AS r_at,
    min(event_at) FILTER (WHERE event_type = '{q._IS['check']}') AS c_at,
    min_by(event_id, {_ORD}) FILTER (WHERE event_type = '{q._IS['check']}') AS c_id,
    min(event_at) FILTER (WHERE event_type = '{q._IS['request']}') AS q_at,
    min_by(event_id, {_ORD}) FILTER (WHERE event_type = '{q._IS['request']}') AS q_id
  FROM ev WHERE case_id IN (SELECT case_id FROM app) GROUP BY 1
),
ruled AS (
  SELECT ev.*, r_at, c_at, q_at, CASE WHEN ev.event_id = c_id THEN 'structured_first_check'
    WHEN ev.event_id = q_id THEN 'earlier_information_request'
    WHEN (event_at, event_id) > (q_at, q_id) THEN 'kept_interval_after_request' END AS rule
  FROM ev LEFT JOIN anch USING (case_id)
),
ov AS (
  SELECT *, event_id AS source_event_id,
    CASE rule WHEN 'structured_first_check' THEN epoch_us(r_at) + 2160000000 - epoch_us(c_at)
      WHEN 'earlier_information_request' THEN epoch_us(r_at) + 2520000000 - epoch_us(q_at)
      WHEN 'kept_interval_after_request' THEN epoch_us(r_at) + 2520000000 - epoch_us(q_at) END AS shift,
    rule = 'structured_first_check' OR (rule = 'kept_interval_after_request' AND event_type = '{q._IS['check']}') AS sys
  FROM ruled
),
ov2 AS (
  SELECT case_id, source_event_id, event_type, rule, event_at AS old_at, manual AS old_manual, actor_type AS old_type,
    CASE WHEN rule IS NULL THEN source_event_id
      ELSE 'sim-' || substr(sha256('{RUN}' || chr(31) || source_event_id || chr(31) || rule), 1, 24) END AS event_id,
    CASE WHEN rule IS NULL THEN event_at ELSE make_timestamp(epoch_us(event_at) + shift) END AS event_at,
    CASE WHEN sys THEN 'system' ELSE actor_type END AS actor_type, NOT coalesce(sys, false) AND manual AS manual
  FROM ov
)"""
)


def _overlay(spark, folder):
    log = session_log(spark, folder, GAP)
    eligible = whatif.case_eligibility(log.events, log.cases, BASELINE, COHORT)
    approved = whatif.approved_cases(
        eligible, log.events, BASELINE, log.scale, seed=SEED, version=VERSION, share=SHARE
    )
    hours = whatif.with_hours(approved, REVIEW_H, SYSTEM_H)
    after = whatif.event_overlay(log.events, hours, BASELINE.roles, RUN)
    return log, eligible, approved, after


@query("rollout_assignment", with_(ELIGIBLE, f"SELECT case_id, round(draw, 9) AS draw, draw < {SHARE} AS selected FROM draw"))
def rollout_assignment(spark, folder):
    got = whatif.rollout_assignment(session_log(spark, folder, GAP).cases, SEED, VERSION, SHARE)
    return got.select("case_id", F.round("draw", 9).alias("draw"), "selected")


@query("approved_cases", with_(ELIGIBLE, "SELECT case_id FROM app ORDER BY case_id LIMIT 5"))
def approved_cases(spark, folder):
    log = session_log(spark, folder, GAP)
    eligible = whatif.case_eligibility(log.events, log.cases, BASELINE, COHORT)
    return whatif.approved_cases(
        eligible, log.events, BASELINE, log.scale, seed=SEED, version=VERSION, share=SHARE, most=5
    )


@query("event_overlay", with_(OVERLAY, "SELECT case_id, source_event_id, event_id, event_type, event_at, actor_type, manual, rule FROM ov2"))
def event_overlay(spark, folder):
    after = _overlay(spark, folder)[3]
    return after.select(
        "case_id", "source_event_id", "event_id", "event_type", "event_at", "actor_type", "manual", "rule"
    )


_CHANGES = """SELECT case_id, source_event_id, event_id, rule,
  round(date_diff('microsecond', old_at, event_at) / 3600000000.0, 6) AS shift_hours,
  array_to_string(list_filter(['replaced', CASE WHEN event_at <> old_at THEN 'timestamp_shifted' END,
    CASE WHEN manual <> old_manual THEN 'manual_marker_changed' END,
    CASE WHEN actor_type <> old_type THEN 'actor_type_changed' END], lambda x: x IS NOT NULL), ',') AS changes
FROM ov2 WHERE rule IS NOT NULL"""


@query("change_log", with_(OVERLAY, _CHANGES))
def change_log(spark, folder):
    log, _, _, after = _overlay(spark, folder)
    got = whatif.change_log(log.events, after)
    return tidy(got.withColumn("changes", joined("changes")))


@query(
    "project_closed_at",
    with_(
        OVERLAY,
        f"""SELECT c.case_id, coalesce(e_at, c.closed_at) AS closed_at,
  CASE WHEN e_at IS NULL THEN c.updated_at ELSE greatest(c.created_at, e_at) END AS updated_at FROM cases c LEFT JOIN
  (SELECT case_id, min_by(event_at, (event_at, event_id)) AS e_at FROM ov2 WHERE event_type IN {q._TERMINAL} GROUP BY 1) USING (case_id)""",
    ),
)
def project_closed_at(spark, folder):
    log, _, _, after = _overlay(spark, folder)
    return whatif.project_closed_at(log.cases, after, BASELINE.roles).select("case_id", "closed_at", "updated_at")


# damage done on purpose, by the last digits of the ids: approvals and changes that are missing, events that are lost or spoilt
@query(
    "symdiff_changed",
    with_(
        OVERLAY,
        """SELECT case_id, CASE WHEN case_id LIKE '%1' THEN 'changed_not_approved' ELSE 'approved_not_changed' END AS problem
FROM (SELECT DISTINCT case_id FROM ov2 WHERE rule IS NOT NULL) WHERE case_id LIKE '%1' OR case_id LIKE '%2'""",
    ),
)
def symdiff_changed(spark, folder):
    """Approvals of some cases and the changes of some others are taken away, so both sides of the difference must be found."""
    log, _, approved, after = _overlay(spark, folder)
    changes = whatif.change_log(log.events, after).where(~F.col("case_id").endswith("2"))
    return whatif.symdiff_changed(changes, approved.where(~F.col("case_id").endswith("1")))


_SPOILT = "(SELECT count(*) FROM ov2 WHERE rule IS NULL AND source_event_id LIKE '%{}')"


@query(
    "overlay_validation",
    with_(
        OVERLAY,
        f"""SELECT 'orphan_events' AS "check", {_SPOILT.format('13')} + (SELECT coalesce(sum(CASE WHEN rule IS NOT NULL THEN 1
    WHEN source_event_id LIKE '%03' OR source_event_id LIKE '%13' THEN 0 WHEN source_event_id LIKE '%09' THEN 2 ELSE 1 END), 0)
  FROM ov2 WHERE case_id NOT IN (SELECT case_id FROM cases))::BIGINT AS rows
UNION ALL SELECT 'missing_times', {_SPOILT.format('05')} UNION ALL SELECT 'order_issues', 0
UNION ALL SELECT 'forbidden_metadata', {_SPOILT.format('11')} UNION ALL SELECT 'repeated_event_ids', {_SPOILT.format('09')}
UNION ALL SELECT 'missing_provenance', 0
UNION ALL SELECT 'policy_change_mismatch', (SELECT count(DISTINCT case_id) FROM ov2 WHERE rule IS NOT NULL AND case_id LIKE '%1')
UNION ALL SELECT 'source_rows_lost', {_SPOILT.format('03')}""",
    ),
)
def overlay_validation(spark, folder):
    """The checks over an altered log that has been damaged in six ways."""
    log, _, approved, after = _overlay(spark, folder)
    ends = lambda digits: F.col("rule").isNull() & F.col("source_event_id").endswith(digits)
    kept = after.where(~ends("03"))
    spoilt = kept.withColumns(
        {
            "ingested_at": F.when(~ends("05"), F.col("ingested_at")),
            "metadata": F.when(ends("11"), F.lit(f'{{"{vocab.FORBIDDEN_KEYS[0]}": 1}}')).otherwise(F.col("metadata")),
            "case_id": F.when(ends("13"), "nobody").otherwise(F.col("case_id")),
        }
    ).unionByName(kept.where(ends("09")))
    few = approved.where(~F.col("case_id").endswith("1"))
    return whatif.overlay_validation(log.events, spoilt, log.cases, whatif.change_log(log.events, after), few, log.scale)


@query(
    "intervention_manifest",
    with_(
        OVERLAY + f", ch AS ({_CHANGES})",
        """SELECT side, value, count(*) AS rows FROM (
  SELECT 'decision' AS side, CASE WHEN case_id IN (SELECT case_id FROM app) THEN 'approved' WHEN reasons = '' THEN 'not_selected'
    ELSE 'ineligible' END AS value FROM elig
  UNION ALL SELECT 'reason', unnest(string_split(reasons, ',')) FROM elig WHERE reasons <> ''
  UNION ALL SELECT 'rule', rule FROM ch
  UNION ALL SELECT 'change', unnest(string_split(changes, ',')) FROM ch) GROUP BY 1, 2""",
    ),
)
def intervention_manifest(spark, folder):
    log, eligible, approved, after = _overlay(spark, folder)
    return whatif.intervention_manifest(eligible, approved, whatif.change_log(log.events, after))


def _simulated(spark, folder):
    """Cohort values of the log and of its altered form."""
    log, _, _, after = _overlay(spark, folder)
    tables = []
    for events in (log.events, pin(after.select(*log.events.columns))):
        wide = pin(case_metrics(events, log.cases, BASELINE, log.scale))
        rollup = cohorts.cohort_rollup(wide, BASELINE)
        tables.append(
            cohorts.cohort_values(rollup, cohorts.cohort_summaries(wide, BASELINE, log.scale), BASELINE)
        )
    return tables


# the whole chain from events to cohort values twice: over the log, and with other names over the altered one
_CHAIN = m.VALUES[m.VALUES.index(",\ncopies AS (") :]
_OWN = sorted(set(re.findall(r"\n(\w+)(?:\([^)]*\))? AS \(", _CHAIN)))
SIMULATED = (
    "RECURSIVE "
    + OVERLAY
    + f""",
evx AS (
  SELECT * REPLACE (
    CASE WHEN rule IS NULL THEN event_id ELSE 'sim-' || substr(sha256('{RUN}' || chr(31) || event_id || chr(31) || rule), 1, 24) END AS event_id,
    CASE WHEN rule IS NULL THEN external_event_id
      ELSE 'SIM-' || upper(substr(sha256('{RUN}' || chr(31) || event_id || chr(31) || rule), 1, 24)) END AS external_event_id,
    CASE WHEN rule IS NULL THEN event_at ELSE make_timestamp(epoch_us(event_at) + shift) END AS event_at,
    CASE WHEN sys THEN 'system' ELSE actor_type END AS actor_type, CASE WHEN NOT coalesce(sys, false) THEN actor_id END AS actor_id,
    CASE WHEN sys THEN 'admin_system' ELSE source_system END AS source_system,
    CASE WHEN sys THEN 'internal_system' ELSE channel END AS channel, NOT coalesce(sys, false) AND manual AS manual) FROM ov
)"""
    + _CHAIN
    + re.sub(rf"\b({'|'.join(_OWN)})\b", r"\1_sim", re.sub(r"\bev\b", "evx", _CHAIN))
).replace("RECURSIVE RECURSIVE", "RECURSIVE")
_EFFECTS = ", ".join(f"('{k}', '{v}')" for k, v in {**whatif.EFFECTS, "first_pass_completeness_rate": "unchanged"}.items())


@query(
    "compare_metrics",
    with_(
        SIMULATED,
        f"""SELECT dimension, value, metric, round(a.observed, 6) AS baseline, round(b.observed, 6) AS simulated,
  round(b.observed - a.observed, 6) AS absolute_difference,
  round(CASE WHEN a.observed <> 0 THEN (b.observed - a.observed) / a.observed END, 6) AS relative_difference, b.sample AS denominator,
  CASE WHEN b.observed - a.observed IS NOT NULL THEN 'calculated' ELSE 'unavailable' END AS status, effect
FROM vals a FULL JOIN vals_sim b USING (dimension, value, metric) JOIN (VALUES {_EFFECTS}) f(metric, effect) USING (metric)""",
    ),
)
def compare_metrics(spark, folder):
    """All measures that the overlay may change, over all cohorts."""
    a, b = _simulated(spark, folder)
    return tidy(whatif.compare_metrics(a, b))


@query("compare_metrics_all", CHECKS["compare_metrics"])
def compare_metrics_all(spark, folder):
    """The same under its earlier name."""
    return compare_metrics(spark, folder)


@query(
    "compare_burden",
    with_(
        SIMULATED,
        """, hours AS (
  SELECT dimension, value, coalesce(a.h, 0) AS baseline_hours, coalesce(b.h, 0) AS simulated_hours, coalesce(r, 0) AS review_hours
  FROM (SELECT dimension, value, coalesce(observed, 0) * cases * 5 / 60 AS h FROM vals WHERE metric = 'manual_touches') a
  FULL JOIN (SELECT dimension, value, coalesce(observed, 0) * cases * 5 / 60 AS h FROM vals_sim WHERE metric = 'manual_touches') b
    USING (dimension, value)
  LEFT JOIN (SELECT 'referral_source' AS dimension, referral_source AS value, count(*) * 5 / 60 AS r FROM app JOIN cases USING (case_id) GROUP BY 2) o
    USING (dimension, value))
SELECT dimension, value, round(baseline_hours, 6) AS baseline_hours, round(simulated_hours, 6) AS simulated_hours,
  round(review_hours, 6) AS review_hours, 0.0::DOUBLE AS fallback_hours, 0.0::DOUBLE AS recovery_hours, round(review_hours, 6) AS operating_hours,
  round(baseline_hours - simulated_hours, 6) AS gross_hours, round(baseline_hours - simulated_hours - review_hours, 6) AS net_hours,
  round(baseline_hours * 24, 6) AS baseline_cost, round(simulated_hours * 24, 6) AS simulated_cost, round(review_hours * 24, 6) AS operating_cost,
  round((baseline_hours - simulated_hours - review_hours) * 24, 6) AS net_cost,
  round((baseline_hours - simulated_hours - review_hours) / 100, 6) AS upper_bound_share FROM hours""",
    ),
)
def compare_burden(spark, folder):
    a, b = _simulated(spark, folder)
    log, eligible, approved, _ = _overlay(spark, folder)
    overhead = approved.join(log.cases.select("case_id", "referral_source"), "case_id").select(
        F.lit("referral_source").alias("dimension"),
        F.col("referral_source").alias("value"),
        F.lit("approved").alias("decision"),
        F.lit(1.0).alias("touches"),
    )
    return tidy(whatif.compare_burden(a, b, overhead, touch_minutes=5, cost_per_hour=24.0, upper_bound_hours=100.0))


@query(
    "compare_process",
    with_(
        q.CM
        + q.PL_FROM_TL
        + q.VARIANTS_FROM_PL
        + """,
pl_part AS (SELECT pl.* FROM pl JOIN (SELECT case_id FROM cases WHERE referral_source = 'gp_practice') USING (case_id)),
edges_part AS (SELECT edges.* FROM edges JOIN (SELECT case_id FROM cases WHERE referral_source = 'gp_practice') USING (case_id)),
cv_part AS (SELECT * FROM cv WHERE case_id IN (SELECT case_id FROM pl_part)),
cores_part AS (SELECT variant_id, count(*) AS cases, CASE WHEN count(*) <= 2 THEN 'rare' ELSE 'common' END AS class FROM cv_part GROUP BY 1)"""
        + m.ranks_sql()
        + m.ranks_sql("_part"),
        f"""SELECT measure, round(a.number, 6) AS baseline, round(b.number, 6) AS simulated, round(b.number - a.number, 6) AS absolute_difference
FROM ({m.complexity_sql('')}) a FULL JOIN ({m.complexity_sql('_part', 'pl_part', 'edges_part')}) b USING (measure)""",
    ),
)
def compare_process(spark, folder):
    """The whole log against the part of one referral source, by all log-level measures."""
    ws = Workspace.of_sessions(spark, folder, store=True)
    # the only case metrics that the measures read: the windows of the others need not run
    effort = pin(case_metrics(ws.log.events, ws.log.cases, BASELINE, ws.scale).select("case_id", "rework_count", "handoffs"))

    def measures(log, cases):
        return variants.complexity(log, cases, variants.variant_cores(cases, MINING), effort, ws.scale)

    part = ws.plog.where("referral_source = 'gp_practice'")
    some = pin(variants.case_variants(part, MINING, ws.scale))
    return tidy(whatif.compare_process(measures(ws.plog, ws.case_variants), measures(part, some)))


RV = (
    q.RAW
    + """,
lk AS (
  SELECT *, lpad(CAST(event_id AS VARCHAR), 12, '0') AS ident,
    last_value(CASE WHEN event_type = 'view' THEN lpad(CAST(event_id AS VARCHAR), 12, '0') END IGNORE NULLS) OVER w AS draft_id,
    last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS draft_at,
    last_value(CASE WHEN event_type = 'view' THEN k END IGNORE NULLS) OVER w AS draft_k,
    last_value(CASE WHEN event_type = 'purchase' THEN lpad(CAST(event_id AS VARCHAR), 12, '0') END IGNORE NULLS) OVER w AS action_id
  FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
),
dr AS (SELECT ident AS draft_id, ts AS created_at, k % 2 + 1 AS revisions FROM lk WHERE event_type = 'view'),
rv AS (SELECT ident AS review_id, draft_id, draft_at, draft_k, k, """
    + q.pick("k", ("approve", "approve_with_edits", "reject", "cancel", "approve"))
    + """ AS decision, ts AS decided_at, value AS review_minutes,
  date_diff('microsecond', draft_at, ts) / 60000000.0 AS latency FROM lk WHERE event_type = 'click' AND draft_id IS NOT NULL),
ac AS (SELECT ident AS action_id, draft_id, draft_at, ts AS acted_at,
  row_number() OVER (PARTITION BY draft_id ORDER BY ts, ident) AS nth FROM lk WHERE event_type = 'purchase' AND draft_id IS NOT NULL),
rb AS (SELECT ident AS rollback_id, draft_id, ts AS rolled_back_at, k % 5 <> 0 AS succeeded FROM lk
  WHERE event_type = 'error' AND k < 20 AND action_id IS NOT NULL),
hist AS (
  SELECT draft_id, created_at AS t, 0 AS seq, 'awaiting_review' AS status FROM dr
  UNION ALL SELECT draft_id, decided_at, 1, CASE decision WHEN 'approve' THEN 'approved' WHEN 'approve_with_edits' THEN 'edited'
    WHEN 'reject' THEN 'rejected' ELSE 'cancelled' END FROM rv
  UNION ALL SELECT draft_id, acted_at, 2, 'committed' FROM ac UNION ALL SELECT draft_id, rolled_back_at, 3, 'rolled_back' FROM rb
),
life AS (
  SELECT draft_id, CASE WHEN last IN ('awaiting_review', 'edited') AND TIMESTAMP '2024-01-25' >= born + INTERVAL 8 HOUR
    THEN 'expired' ELSE last END AS status FROM (
    SELECT draft_id, max_by(status, (t, seq)) AS last, min(t) AS born FROM hist WHERE t <= TIMESTAMP '2024-01-25' GROUP BY 1)
)"""
)


def _as_of():
    from datetime import datetime

    return F.lit(datetime(2024, 1, 25)).cast("timestamp")


@query("join_review_draft", with_(RV, "SELECT review_id, draft_id, round(latency, 4) AS latency_minutes FROM rv"))
def join_review_draft(spark, folder):
    parts, _ = sn.review_records(spark, folder)
    reviews = parts["reviews"].drop("created_at")
    got = review.join_review_draft(reviews, parts["drafts"])
    return tidy(got.select("review_id", "draft_id", "latency_minutes"), 4)


@query(
    "latency_summary",
    with_(
        RV,
        """SELECT decision, count(*) AS n, round(avg(latency), 6) AS mean, round(median(latency), 6) AS median,
  round(quantile_cont(latency, 0.95), 6) AS p95, round(max(latency), 6) AS max, round(avg(CAST(latency <= 240 AS INT)), 6) AS slo_rate
FROM rv GROUP BY 1""",
    ),
)
def latency_summary(spark, folder):
    parts, scale = sn.review_records(spark, folder)
    timed = review.join_review_draft(parts["reviews"].drop("created_at"), parts["drafts"])
    got = review.latency_summary(timed, ["decision"], "latency_minutes", scale)
    return tidy(got.select("decision", "n", "mean", "median", "p95", "max", "slo_rate"))


@query(
    "idempotent_actions",
    with_(RV, "SELECT action_id, draft_id, CASE WHEN nth = 1 THEN 'committed' ELSE 'duplicate_suppressed' END AS status FROM ac"),
)
def idempotent_actions(spark, folder):
    parts, scale = sn.review_records(spark, folder)
    return review.idempotent_actions(parts["actions"], scale).select("action_id", "draft_id", "status")


@query("review_lifecycle_state", with_(RV, "SELECT draft_id, status FROM life"))
def review_lifecycle_state(spark, folder):
    parts, _ = sn.review_records(spark, folder)
    return review.lifecycle_state(sn.draft_history(parts), _as_of(), REVIEW).select("draft_id", "status")


_POLICY = {
    "role_not_permitted": "k % 3 = 2",
    "recommendation_not_current": "draft_k % 17 = 0",
    "unresolved_source_conflict": "draft_k % 19 = 0",
    "draft_expired": "decided_at >= draft_at + INTERVAL 8 HOUR",
    "missing_provenance": "draft_k % 23 = 0",
    "stale_revision": "k % 2 <> draft_k % 2",
}


@query(
    "review_policy_check",
    with_(
        RV,
        "SELECT code, count(*) AS rows FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS code FROM rv WHERE {w}" for c, w in _POLICY.items())
        + ") GROUP BY 1",
    ),
)
def review_policy_check(spark, folder):
    parts, _ = sn.review_records(spark, folder)
    own = parts["drafts"].select("draft_id", "current", "conflict")
    prov = F.when(F.pmod(F.col("draft_k"), F.lit(23)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s")))
    attempts = parts["reviews"].join(own, "draft_id").withColumns(
        {
            "draft_status": F.lit("awaiting_review"),
            "revision_id": F.pmod(F.col("k"), F.lit(2)),
            "current_revision_id": F.pmod(F.col("draft_k"), F.lit(2)),
            "expires_at": F.timestamp_micros(F.unix_micros("created_at") + REVIEW.expiry_hours * 3_600_000_000),
            "source_references": prov,
            "requirement_references": prov,
        }
    )
    return quality.violation_counts(review.review_policy_check(attempts, REVIEW))


CHAIN_KINDS = "('click', 'purchase', 'error')"
_FALSE_MINUTES = (
    "(SELECT sum(review_minutes) FROM rv) * (SELECT greatest(count(*) FILTER (WHERE event_type = 'view') - "
    "count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 0), 0) / count(*) FILTER (WHERE event_type = 'view') FROM raw)"
)
_WORK = {
    "drafts_created": "(SELECT count(*) FROM dr)",
    "drafts_reviewed": "(SELECT count(DISTINCT draft_id) FROM rv)",
    "drafts_approved": "(SELECT count(*) FROM rv WHERE decision LIKE 'approve%')",
    "drafts_rejected": "(SELECT count(*) FROM rv WHERE decision = 'reject')",
    "drafts_expired": "(SELECT count(*) FROM life WHERE status = 'expired')",
    "unresolved_drafts": "(SELECT count(*) FROM life WHERE status IN ('awaiting_review', 'edited', 'approved'))",
    "tasks_committed": "(SELECT count(*) FROM ac WHERE nth = 1)",
    "duplicate_actions_prevented": "(SELECT count(*) FROM ac WHERE nth > 1)",
    "rollbacks": "(SELECT count(*) FROM rb)",
    "rollback_success_rate": "(SELECT avg(CAST(succeeded AS INT)) FROM rb)",
    "review_minutes": "(SELECT sum(review_minutes) FROM rv)",
    "mean_time_to_review_minutes": "(SELECT avg(latency) FROM rv)",
    "mean_time_to_approval_minutes": "(SELECT avg(latency) FROM rv WHERE decision LIKE 'approve%')",
    "review_slo_compliance": "(SELECT avg(CAST(latency <= 240 AS INT)) FROM rv)",
    "p95_review_latency_minutes": "(SELECT list_sort(list(latency))[1 + CAST(least(count(*) - 1, floor(0.95 * count(*))) AS BIGINT)] FROM rv)",
    "mean_time_to_task_minutes": "(SELECT avg(date_diff('microsecond', draft_at, acted_at) / 60000000.0) FROM ac WHERE nth = 1)",
    "duplicate_action_rate": "(SELECT count(*) FILTER (WHERE nth > 1) / count(*) FROM ac)",
    "expiry_rate": "(SELECT count(*) FILTER (WHERE status = 'expired') FROM life) / (SELECT count(*) FROM dr)",
    "audit_completeness": "least(1.0, (SELECT count(*) FROM raw WHERE event_type IN " + CHAIN_KINDS
    + ") / ((SELECT count(*) FROM rv) + (SELECT count(*) FROM ac) + (SELECT count(*) FROM rb)))",
    "detector_precision": "(SELECT count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 0) / count(*) FILTER (WHERE event_type = 'view') FROM raw)",
    "incoming_cases": "(SELECT count(*) FROM raw)",
    "detector_positives": "(SELECT count(*) FROM raw WHERE event_type = 'view')",
    "detector_positive_coverage": "(SELECT count(*) FILTER (WHERE event_type = 'view') / count(*) FROM raw)",
    "detector_recall": "(SELECT count(*) FILTER (WHERE event_type = 'view' AND k % 3 = 0) / count(*) FILTER (WHERE k % 3 = 0) FROM raw)",
    "surfaced_recommendation_coverage": "(SELECT count(*) FROM dr) / (SELECT count(*) FROM raw)",
    "drafts_edited": "(SELECT count(*) FROM dr WHERE revisions > 1)",
    "drafts_cancelled": "(SELECT count(*) FROM rv WHERE decision = 'cancel')",
    "drafts_retracted": "(SELECT count(*) FROM life WHERE status = 'retracted')",
    "reviewer_agreement": "(SELECT avg(CAST(agree AS INT)) FROM (SELECT min(decision LIKE 'approve%') = max(decision LIKE 'approve%') AS agree "
    "FROM rv GROUP BY draft_id HAVING count(*) > 1))",
    "approval_rate": "(SELECT count(*) FILTER (WHERE decision LIKE 'approve%') / count(DISTINCT draft_id) FROM rv)",
    "edit_rate": "(SELECT count(*) FROM dr WHERE revisions > 1) / (SELECT count(DISTINCT draft_id) FROM rv)",
    "rejection_rate": "(SELECT count(*) FILTER (WHERE decision = 'reject') / count(DISTINCT draft_id) FROM rv)",
    "false_positive_review_minutes": _FALSE_MINUTES,
    "false_positive_review_minutes_per_100_cases": f"{_FALSE_MINUTES} * 100 / (SELECT count(*) FROM raw)",
    "maximum_queue_depth": "(SELECT count(*) FROM dr)",
}


def _workload(spark, folder):
    parts, scale = sn.review_records(spark, folder)
    state = review.lifecycle_state(sn.draft_history(parts), _as_of(), REVIEW).select("draft_id", "status")
    drafts = parts["drafts"].join(state, "draft_id", "left")
    actions = review.idempotent_actions(parts["actions"], scale)
    records, _ = sn.audit_records(spark, folder)
    chain = review.audit_summary(review.audit_verify(review.audit_build(records, scale), scale))
    audit = chain.select(F.col("records").alias("audited_events"), "broken_links")
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    seen = F.col("event_type") == "view"
    true = F.pmod(F.col("k"), F.lit(3)) == 0
    coverage = e.agg(
        F.count(F.lit(1)).alias("incoming_cases"),
        F.count_if(seen).alias("positives"),
        F.count_if(seen & true).alias("true_positives"),
        F.count_if(true).alias("evaluable"),
    )
    return review.workload_metrics(
        coverage, drafts, parts["reviews"].drop("created_at"), actions, parts["rollbacks"], audit, scale
    )


@query(
    "workload_metrics",
    with_(RV, " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS number" for n, e in _WORK.items())),
)
def workload_metrics(spark, folder):
    return tidy(_workload(spark, folder))


_LIMITS = [(g, m, o, float(REVIEW.thresholds[t]) if isinstance(t, str) else t, missing) for g, _, m, o, t, missing in review.GATES]
GATED = (
    RV
    + ", met AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({e} AS DOUBLE) AS number" for n, e in _WORK.items())
    + "), limits(gate, metric, comparison, threshold, if_missing) AS (VALUES "
    + ", ".join(f"('{g}', '{m}', '{o}', CAST({t} AS DOUBLE), CAST({'NULL' if x is None else x} AS DOUBLE))" for g, m, o, t, x in _LIMITS)
    + """), judged AS (
  SELECT gate, metric, coalesce(number, if_missing) AS actual, threshold,
    CASE WHEN coalesce(CASE comparison WHEN '<=' THEN coalesce(number, if_missing) <= threshold WHEN '>=' THEN coalesce(number, if_missing) >= threshold
      ELSE coalesce(number, if_missing) = threshold END, false) THEN 'pass' ELSE 'fail' END AS status
  FROM limits LEFT JOIN met USING (metric)
)"""
)


@query(
    "gates",
    with_(GATED, "SELECT gate, metric, round(actual, 6) AS actual, round(threshold, 6) AS threshold, status FROM judged"),
)
def gates(spark, folder):
    got = review.evaluate_gates(_workload(spark, folder), review.gate_table(spark, REVIEW))
    return tidy(got.select("gate", "metric", "actual", "threshold", "status"))


@query(
    "gate_assessment",
    with_(
        GATED,
        """SELECT count(*) FILTER (WHERE status = 'fail') AS failures,
  CASE WHEN bool_or(status = 'fail' AND regexp_matches(gate, '^(safety-|audit-|policy-)')) THEN 'pause_due_to_stop_condition'
    WHEN bool_or(status = 'fail') THEN 'revise_pilot_design' ELSE 'ready' END AS assessment FROM judged""",
    ),
)
def gate_assessment(spark, folder):
    return review.gate_assessment(review.evaluate_gates(_workload(spark, folder), review.gate_table(spark, REVIEW)))


# --- audit ------------------------------------------------------------------------
_ACTION = "CASE event_type WHEN 'click' THEN 'draft_review' WHEN 'purchase' THEN 'committed_task' ELSE 'rollback_task' END"
AUDIT = (
    "RECURSIVE "
    + q.RAW
    + f""",
au AS (
  SELECT CAST(user_id AS VARCHAR) AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    lpad(CAST(event_id AS VARCHAR), 12, '0') AS audit_id, epoch_us(ts) AS us, {_ACTION} AS action,
    '2:case-' || user_id || chr(30) || {qi._sid('event_id')} AS inputs,
    CASE WHEN event_type = 'purchase' THEN '1:task-' || event_id ELSE '0:' END AS outputs,
    CASE k % 4 WHEN 0 THEN '2:late' || chr(30) || 'checked' WHEN 1 THEN '1:late' ELSE '0:' END AS reasons
  FROM raw WHERE event_type IN {CHAIN_KINDS}
),
pay AS (SELECT *, sha256(audit_id || chr(31) || chain_id || chr(31) || seq || chr(31) || us || chr(31) || 'admin_reviewer' || chr(31)
  || action || chr(31) || audit_id || chr(31) || inputs || chr(31) || outputs || chr(31) || reasons) AS payload FROM au),
link AS (
  SELECT chain_id, seq, audit_id, CAST(NULL AS VARCHAR) AS prev, sha256(payload) AS fp FROM pay WHERE seq = 1
  UNION ALL SELECT p.chain_id, p.seq, p.audit_id, l.fp, sha256(p.payload || l.fp) FROM link l JOIN pay p
    ON p.chain_id = l.chain_id AND p.seq = l.seq + 1
)"""
)


@query(
    "audit_build",
    with_(AUDIT, "SELECT chain_id, seq, audit_id, prev AS previous_fingerprint, fp AS fingerprint FROM link"),
)
def audit_build(spark, folder):
    records, scale = sn.audit_records(spark, folder)
    return review.audit_build(records, scale).select(
        "chain_id", "seq", "audit_id", "previous_fingerprint", "fingerprint"
    )


@query(
    "audit_verify",
    with_(
        AUDIT,
        "SELECT count(*) AS records, count(DISTINCT chain_id) AS chains, count(*) FILTER (WHERE CAST(audit_id AS BIGINT) % 1000 IN (7, 8)) AS broken_links FROM au",
    ),
)
def audit_verify(spark, folder):
    records, scale = sn.audit_records(spark, folder)
    chain = review.audit_build(records, scale)
    # change the content of some records: each must be found, and only those
    bad = F.pmod(F.col("audit_id").cast("long"), F.lit(1000)) == 7
    tampered = chain.withColumn("actor_role", F.when(bad, "someone_else").otherwise(F.col("actor_role")))
    reworded = F.pmod(F.col("audit_id").cast("long"), F.lit(1000)) == 8
    tampered = tampered.withColumn("reason_codes", F.when(reworded, F.array(F.lit("other"))).otherwise(F.col("reason_codes")))
    return review.audit_summary(review.audit_verify(tampered, scale))


# --- confusion ---------------------------------------------------------------------
_TEXT_HIT = (
    "contains(lower(text), 'diagnosis') OR regexp_matches(lower(text), '[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{2,}') "
    "OR regexp_matches(lower(text), '\\b\\d{3}[- ]?\\d{3}[- ]?\\d{4}\\b')"
)


@query(
    "confusion_metrics",
    f"""WITH p AS (SELECT doc_id AS id, n_chars > 1000 AS predicted FROM documents), t AS (SELECT doc_id AS id, quality = 1 AS positive FROM labels),
c AS (SELECT count(*) FILTER (WHERE predicted AND positive) AS tp, count(*) FILTER (WHERE predicted AND NOT positive) AS fp,
  count(*) FILTER (WHERE NOT predicted AND NOT positive) AS tn, count(*) FILTER (WHERE NOT predicted AND positive) AS fn,
  count(*) FILTER (WHERE positive IS NULL) AS unlabelled, count(*) FILTER (WHERE predicted IS NULL) AS unpredicted
  FROM p FULL JOIN t USING (id))
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(tn / nullif(tn + fp, 0), 6) AS specificity, round(fp / nullif(tn + fp, 0), 6) AS false_positive_rate,
  round(fn / nullif(tp + fn, 0), 6) AS false_negative_rate, round(tn / nullif(tn + fn, 0), 6) AS negative_predictive_value,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round((tp + fp) / nullif(tp + fp + tn + fn, 0), 6) AS coverage FROM c""",
)
def confusion_metrics(spark, folder):
    # prediction: long documents are of good quality
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 1000).alias("predicted"))
    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("positive"))
    got = review.confusion_metrics(docs, truth)
    return tidy(got)


# --- lineage ------------------------------------------------------------------------
def _fingerprint_sql(source: str, columns: list[str], where: str = "true") -> str:
    text = " || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(columns))
    level = f"""WITH h0 AS (SELECT sha256({text}) AS h FROM {source} WHERE {where}),
h1 AS (SELECT h, count(*) AS n, sha256(h || ':' || count(*)) AS d FROM h0 GROUP BY 1)"""
    last = "h1"
    for i, length in enumerate(lineage.LEVELS):
        name = f"l{i}"
        level += f""",
{name} AS (SELECT substr(h, 1, {length}) AS g, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY h)) AS d FROM {last} GROUP BY 1),
{name}x AS (SELECT g AS h, n, d FROM {name})"""
        last = f"{name}x"
    return level + f"\nSELECT n AS rows, d AS fingerprint FROM {last}"


_FP = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("dataset_fingerprint", _fingerprint_sql("events", _FP))
def dataset_fingerprint(spark, folder):
    return lineage.dataset_fingerprint(table(spark, folder, "events"), _FP)


@query(
    "result_fingerprint",
    _fingerprint_sql("(SELECT event_type, count(*) AS n FROM events GROUP BY 1)", ["event_type", "n"]),
)
def result_fingerprint(spark, folder):
    got = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return lineage.dataset_fingerprint(got, ["event_type", "n"])


@query(
    "join_lineage",
    _fingerprint_sql("events", _FP).replace("SELECT n AS rows, d AS fingerprint", "SELECT d AS left_fp, true AS compatible"),
)
def join_lineage(spark, folder):
    e = table(spark, folder, "events")
    shuffled = e.repartition(7, "user_id")  # another order of the same rows
    return lineage.join_lineage(lineage.dataset_fingerprint(e, _FP), lineage.dataset_fingerprint(shuffled, _FP))


# --- files -------------------------------------------------------------------------------
def _place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(
    "scan_jsonl_snapshots",
    with_(qi.SNAP, "SELECT snapshot_id, case_id, available_at, source_system, form_version, state, applies FROM sn"),
)
def scan_jsonl_snapshots(spark, folder):
    path = sinks.write_rows(sn.snapshots(table(spark, folder, "events")), _place(spark))
    good, _ = files.read_snapshots(spark, path)
    doc = F.get(F.filter("fields", lambda f: f["field_id"] == "supporting_document"), F.lit(0))
    return good.select(
        "snapshot_id", "case_id", "available_at", "source_system", "form_version",
        doc["state"].alias("state"), doc["applicable"].alias("applies"),
    )


@query("scan_jsonl_labels", with_(q.RAW + qi.LAB, "SELECT label_id, case_id, valid_from, valid_until, status FROM lab"))
def scan_jsonl_labels(spark, folder):
    path = sinks.write_rows(sn.label_intervals(table(spark, folder, "events")), _place(spark))
    good, _ = files.read_labels(spark, path)
    return good.select("label_id", "case_id", "valid_from", "valid_until", "status")


@query(
    "scan_jsonl_bad_lines",
    with_(
        qi.SNAP + qi.LAB,
        """SELECT 'snapshots' AS entity, count(*) FILTER (WHERE snapshot_id NOT LIKE '%7') AS good, count(*) FILTER (WHERE snapshot_id LIKE '%7') AS bad FROM sn
UNION ALL SELECT 'labels', count(*) FILTER (WHERE label_id NOT LIKE '%7'), count(*) FILTER (WHERE label_id LIKE '%7') FROM lab""",
    ),
)
def scan_jsonl_bad_lines(spark, folder):
    """Lines that were cut off are told apart from the good ones and keep their text."""
    e, found = table(spark, folder, "events"), []
    for entity, rows, id, read in (
        ("snapshots", sn.snapshots(e), "snapshot_id", files.read_snapshots),
        ("labels", sn.label_intervals(e), "label_id", files.read_labels),
    ):
        line = F.to_json(F.struct(*rows.columns), {"timestampFormat": sinks.JSON_TIME})
        path = _place(spark)
        cut = F.substring(line, F.lit(1), F.length(line) - 9)
        rows.select(F.when(F.col(id).endswith("7"), cut).otherwise(line)).write.text(path)
        good, bad = read(spark, path)
        one = good.agg(F.count(F.lit(1)).alias("good")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("bad"))))  # one row each
        found.append(one.select(F.lit(entity).alias("entity"), "good", "bad"))
    return reduce(DataFrame.unionByName, found)


@query(
    "scan_bundle_json",
    with_(
        q.CASES + qi.LAB,
        """SELECT * FROM (
  SELECT 'cases' AS entity, status AS kind, count(*) AS good, CAST(0 AS BIGINT) AS bad FROM cases GROUP BY 2
  UNION ALL SELECT 'events', event_type, count(*) FILTER (WHERE event_id[-2:] <> '07'), count(*) FILTER (WHERE event_id[-2:] = '07')
    FROM ev JOIN cases USING (case_id) GROUP BY 2
  UNION ALL SELECT 'labels', status, count(*), 0 FROM lab WHERE case_id IN (SELECT split_part(case_id, '-', 1) FROM cases) GROUP BY 2
  UNION ALL SELECT 'manifest', 'complete', count(DISTINCT split_part(case_id, '-', 1)), 0 FROM cases)""",
    ),
)
def scan_bundle_json(spark, folder):
    """The log as nested bundles, one of each user; some events carry a broken time.  Read back in byte ranges, bad records aside."""
    log, raw = session_log(spark, folder), table(spark, folder, "events")
    names = {e: [p.strip().split(" ")[0] for p in files._split(d)] for e, d in files.BUNDLE_DDL.items()}
    user = F.split_part("case_id", F.lit("-"), F.lit(1))
    time = F.date_format("event_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    spoilt = log.events.join(log.cases.select("case_id"), "case_id", "left_semi").withColumn(
        "event_at", F.when(F.col("event_id").endswith("07"), "no time").otherwise(time)
    )
    rows = lambda df, e: df.select(user.alias("user"), F.struct(*[c for c in names[e] if c in df.columns]).alias(e))
    labels = rows(sn.label_intervals(raw), "labels")
    parts = [rows(log.cases, "cases"), rows(spoilt, "events"), labels]
    gathered = [p.groupBy("user").agg(F.collect_list(p.columns[1]).alias(p.columns[1])) for p in parts]
    bundles = gathered[0].join(gathered[1], "user", "left").join(gathered[2], "user", "left")
    manifest = F.struct(F.col("user").alias("run_id"), F.size("cases").alias("case_count"))
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    text = F.to_json(F.struct("cases", "events", "labels", manifest.alias("manifest")), options)
    place = _place(spark)
    bundles.select(text).write.text(place)
    good, bad = files.split_bundle(spark, place)
    kinds = {"cases": F.col("status"), "events": F.col("event_type"), "labels": F.col("status"), "manifest": F.lit("complete")}
    counted = [df.select(F.lit(e).alias("entity"), kinds[e].alias("kind"), F.lit(1).alias("good"), F.lit(0).alias("bad")) for e, df in good.items()]
    counted.append(bad.select("entity", F.get_json_object("text", "$.event_type").alias("kind"), F.lit(0).alias("good"), F.lit(1).alias("bad")))
    every = reduce(DataFrame.unionByName, counted)
    return every.groupBy("entity", "kind").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@query(
    "scan_research",
    "SELECT role, count(*) AS observations, count(DISTINCT conv_id) AS sessions FROM conversations WHERE role <> 'system' GROUP BY 1",
)
def scan_research(spark, folder):
    from ..operators.opportunities import ARCHETYPES

    flat = sn.research_observations(spark, folder, tuple(ARCHETYPES))
    entry = F.struct(
        "observation_id", "affected_role", "cohort_dimension", "cohort_value", "reported_problem", "severity",
        "supported_archetypes", "contradicts",
    )
    nested = flat.select(
        "session_id", "participant_id", F.col("session_role").alias("role"), F.array(entry).alias("observations")
    )
    path = sinks.write_rows(nested, _place(spark))
    back = files.flatten_research(spark.read.schema(files.RESEARCH_SESSION).json(path))
    return back.groupBy(F.col("session_role").alias("role")).agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("session_id").alias("sessions")
    )


@query(
    "scan_contract_json",
    with_(qi.SNAP, "SELECT form_no, count(*) AS snapshots FROM fm WHERE form_no IS NOT NULL GROUP BY 1"),
)
def scan_contract_json(spark, folder):
    """Snapshots dated against a contract that was written to and read from a JSON file."""
    from ..operators.contracts import effective_form

    forms = sn.contract_forms(spark)
    entry = F.struct(
        "form_identifier", "form_version", F.col("unsupported_sources").alias("unsupported_source_combinations"),
        "effective_from", "effective_until",
    )
    one = forms.agg(F.array_sort(F.collect_list(F.struct("form_no", entry.alias("f")))).alias("x")).select(
        F.lit("c").alias("contract_id"), F.lit("requirements-v2").alias("contract_version"),
        F.transform("x", lambda e: e["f"]).alias("forms"),
    )
    place = _place(spark)
    sinks.write_rows(one.coalesce(1), place)
    read, _ = files.read_contract(spark, place)
    dated = effective_form(sn.snapshots(table(spark, folder, "events")), read.drop("contract_version"))
    return (
        dated.where(F.col("form_no").isNotNull())
        .groupBy(F.col("form_no").cast("long").alias("form_no"))
        .agg(F.count(F.lit(1)).alias("snapshots"))
    )


@query("scan_artifacts", with_(q.PL, "SELECT source, target, count(*) AS frequency FROM edges GROUP BY 1, 2"))
def scan_artifacts(spark, folder):
    """An earlier result read back as the input of a later stage."""
    from ..operators.mining import dfg_frequency

    place = _place(spark)
    sinks.write_tables({"edges": dfg_frequency(Workspace.of_sessions(spark, folder).plog)}, place)
    return sinks.read_tables(spark, place, "edges")["edges"]


@query(
    "sink_result_tables",
    with_(q.PL, "SELECT 'activities' AS name, count(DISTINCT activity) AS rows FROM pl UNION ALL "
          "SELECT 'edges', count(DISTINCT (source, target)) FROM edges"),
)
def sink_result_tables(spark, folder):
    from ..operators.mining import activity_stats, dfg_frequency

    log, place = Workspace.of_sessions(spark, folder).plog, _place(spark)
    sinks.write_tables({"activities": activity_stats(log), "edges": dfg_frequency(log)}, place)
    got = sinks.read_tables(spark, place, "activities", "edges")
    rows = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in got.items()
    ]
    return rows[0].unionByName(rows[1])


@query("sink_case_rows", with_(q.CASES, "SELECT case_id, status, received_at, closed_at FROM cases"))
def sink_case_rows(spark, folder):
    path = sinks.write_rows(session_log(spark, folder).cases, _place(spark))
    good, _ = files.read_jsonl(spark, path, files.CASE_DDL)
    return good.select("case_id", "status", "received_at", "closed_at")


@query(
    "sink_manifest_tables",
    with_(q.CASES, "SELECT 'run-1' AS run_id, (SELECT count(*) FROM cases) AS case_count, (SELECT count(*) FROM ev) AS event_count"),
)
def sink_manifest_tables(spark, folder):
    log, place = session_log(spark, folder), _place(spark)
    manifest = (
        log.cases.agg(F.count(F.lit(1)).alias("case_count"))
        .crossJoin(log.events.agg(F.count(F.lit(1)).alias("event_count")))
        .select(F.lit("run-1").alias("run_id"), "case_count", "event_count")
    )
    sinks.write_rows(manifest, f"{place}/manifest")
    sinks.write_tables({"cases": log.cases, "events": log.events}, place)
    back = spark.read.schema("run_id string, case_count long, event_count long").json(f"{place}/manifest")
    stored = sinks.read_tables(spark, place, "cases", "events")
    checked = files.check_counts(stored["events"], stored["cases"], back)
    return back.crossJoin(checked.where("complete").select(F.lit(1).alias("_ok"))).drop("_ok")


@query(
    "sink_idempotent_run",
    """SELECT event_type, run_id, count(*) AS events, 'written' AS first_load, 'unchanged' AS second_load, 'refused' AS other_load
FROM events, (SELECT unnest(['run-1', 'run-2']) AS run_id) WHERE run_id = 'run-1' OR event_id % 2 = 0 GROUP BY 1, 2""",
)
def sink_idempotent_run(spark, folder):
    """Two runs: each loaded twice is stored once, other content under its id is refused, what a dead writer left is not read."""
    place, e = _place(spark), table(spark, folder, "events")
    said = []
    for run, rows in (("run-1", e), ("run-2", e.where("event_id % 2 = 0"))):
        rows.limit(5).write.parquet(f"{place}/events/run_id={run}/attempt=dead")  # a writer that never published
        first, second = (sinks.write_run(spark, place, run, {"events": rows}, f"print of {run}") for _ in range(2))
        try:
            other = sinks.write_run(spark, place, run, {"events": rows.limit(1)}, "another print")
        except ValueError:
            other = "refused"
        said.append((run, first, second, other))
    loads = spark.createDataFrame(said, "run_id string, first_load string, second_load string, other_load string")
    return (
        sinks.read_runs(spark, place, "events").groupBy("event_type", "run_id").agg(F.count(F.lit(1)).alias("events")).join(loads, "run_id")
    )
