"""Registered queries: intake snapshots, contracts, the detector and its streams."""

from __future__ import annotations

from dataclasses import astuple, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import contracts as ct
from ..session import Scale
from ..sources import snapshots as sn
from ..sources.tables import session_events, table, table_scale
from ..spec import BaselineSpec, ContractSpec, DetectorSpec
from ..streaming import asof, resume, timers
from ..streaming import detector as det
from ..streaming import monitors as mo
from . import sql as q
from .registry import query, tidy
from .sql import with_

SPEC = ContractSpec()
DET = DetectorSpec()


def _state(raw: str = "event_type") -> str:
    return f"""CASE WHEN {raw} = 'purchase' THEN 'present'
  WHEN {raw} = 'view' THEN CASE WHEN k < 40 THEN 'present' ELSE 'absent' END
  WHEN {raw} = 'click' THEN CASE WHEN k < 50 THEN 'pending_source_update' ELSE 'verification_required' END
  WHEN {raw} = 'signup' THEN CASE WHEN k < 30 THEN 'unknown' WHEN k < 60 THEN 'not_applicable' ELSE 'absent' END
  ELSE CASE WHEN k < 20 THEN 'conflicting' WHEN k < 40 THEN 'stale' WHEN k < 60 THEN 'unsupported' ELSE 'absent' END END"""


def _sid(expr: str) -> str:
    return f"'S' || lpad(CAST(CASE WHEN ({expr}) % 25 = 24 THEN ({expr}) - 1 ELSE ({expr}) END AS VARCHAR), 12, '0')"


_UPDATE = q.pick("k", ("retry", "supersession", "correction", "initial", "initial", "initial", "initial"))

SNAP = (
    q.RAW
    + f""",
sn AS (
  SELECT {_sid('event_id')} AS snapshot_id, CAST(user_id AS VARCHAR) AS case_id, ts AS available_at,
    ts + to_minutes(CASE WHEN k % 10 = 0 THEN 5 ELSE -k END) AS source_event_at,
    {q.pick('k', ('referral_portal', 'secure_email', 'manual_entry', 'admin_system'))} AS source_system,
    'R' || user_id || '-' || (k % 5) || '|' || (k % 3 + 1) AS delivery, k % 3 + 1 AS version,
    CASE WHEN k % 10 < 5 THEN 'INTAKE-2' WHEN k % 10 < 9 THEN 'INTAKE-1' ELSE 'INTAKE-9' END AS form_version,
    CASE WHEN k % 12 = 11 THEN 'requirements-v1' ELSE 'requirements-v2' END AS contract,
    {_state()} AS state,
    CASE WHEN k % 15 <> 14 THEN ({_state()}) <> 'not_applicable' OR k % 6 = 0 END AS applies,
    k % 30 = 29 AS extra, k % 8 = 7 AS warned,
    CASE WHEN k % 9 = 0 THEN 'started' WHEN k % 9 = 1 THEN 'completed' WHEN k % 9 = 2 THEN 'unavailable'
      ELSE 'not_started' END AS review,
    CASE WHEN k % 11 = 10 THEN 'stale' WHEN k % 13 = 12 THEN 'unknown' ELSE 'fresh' END AS freshness,
    CASE WHEN k % 14 = 13 THEN 'detected' ELSE 'none' END AS conflict,
    {_UPDATE} AS update_type,
    CASE WHEN {_UPDATE} = 'supersession' AND k % 4 <> 3 THEN {_sid('event_id - 1')} END AS superseded,
    CASE WHEN k % 16 = 15 THEN ' ' ELSE 'producer-' || (k % 3) END AS producer, k % 5 <> 4 AS proven,
    CASE WHEN k % 18 = 17 THEN 'other' ELSE '{SPEC.declaration}' END AS declaration, k
  FROM raw
),
fm AS (
  SELECT *, CASE
    WHEN form_version = 'INTAKE-2' AND available_at >= TIMESTAMP '2024-01-05' AND source_system <> 'manual_entry' THEN 0
    WHEN form_version = 'INTAKE-2' AND available_at >= TIMESTAMP '2024-01-01' AND available_at < TIMESTAMP '2024-01-10' THEN 1
    WHEN form_version = 'INTAKE-1' AND available_at >= TIMESTAMP '2024-01-01' AND source_system <> 'secure_email' THEN 2
    END AS form_no
  FROM sn
)"""
)
LAB = """,
lab AS (
  SELECT 'L' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS label_id, CAST(user_id AS VARCHAR) AS case_id,
    ts - INTERVAL 5 DAY AS valid_from, CASE WHEN k < 80 THEN ts + INTERVAL 5 DAY END AS valid_until,
    CASE WHEN k % 3 <> 0 THEN 'positive' ELSE 'negative' END AS status
  FROM raw WHERE event_type = 'signup'
)"""


def _snaps(spark, folder):
    return sn.snapshots(table(spark, folder, "events"))


def _scale(spark, folder) -> Scale:
    return table_scale(spark, folder, "events")


@query(
    "project_snapshot_view",
    with_(
        SNAP,
        f"""SELECT case_id, snapshot_id, 2 AS schema_version, available_at, source_system, form_version, state AS document_state,
  contract AS requirements_contract_version FROM sn
UNION ALL SELECT case_id, snapshot_id, 1, available_at, source_system, 'INTAKE-1',
  {q.pick('k', ('present', 'absent', 'unknown'))}, NULL FROM sn""",
    ),
)
def project_snapshot_view(spark, folder):
    old = sn.snapshots_v1(table(spark, folder, "events"))
    return ct.snapshot_view(old, _snaps(spark, folder), SPEC)


@query("join_effective_dated", with_(SNAP, "SELECT snapshot_id, available_at, source_system, form_no FROM fm"))
def join_effective_dated(spark, folder):
    got = ct.effective_form(_snaps(spark, folder), sn.contract_forms(spark))
    return got.select("snapshot_id", "available_at", "source_system", "form_no")


@query(
    "required_rules",
    with_(
        SNAP,
        """SELECT form_no, requirement_id, count(*) AS snapshots FROM fm, (VALUES ('intake-form'), ('document'), ('contact')) r(requirement_id)
WHERE form_no IS NOT NULL AND (requirement_id <> 'contact' OR state = 'present') GROUP BY 1, 2""",
    ),
)
def required_rules(spark, folder):
    dated = ct.effective_form(_snaps(spark, folder), sn.contract_forms(spark)).where(F.col("form_no").isNotNull())
    got = ct.required_rules(dated, sn.contract_rules(spark))
    return got.groupBy("form_no", "requirement_id").agg(F.count(F.lit(1)).alias("snapshots"))


@query(
    "join_asof_label",
    with_(
        SNAP + LAB,
        """SELECT s.snapshot_id, s.case_id, s.available_at AS as_of, coalesce((SELECT max_by(l.status, (l.valid_from, l.label_id)) FROM lab l
  WHERE l.case_id = s.case_id AND l.valid_from <= s.available_at AND (l.valid_until IS NULL OR s.available_at < l.valid_until)),
  'not_evaluable') AS label FROM sn s""",
    ),
)
def join_asof_label(spark, folder):
    e = table(spark, folder, "events")
    facts = sn.snapshots(e).select("snapshot_id", "case_id", F.col("available_at").alias("as_of"))
    return ct.asof_label(facts, sn.label_intervals(e)).select("snapshot_id", "case_id", "as_of", "label")


@query(
    "latest_per_key",
    with_(
        SNAP,
        """SELECT case_id, producer, snapshot_id, available_at, state FROM sn
QUALIFY row_number() OVER (PARTITION BY case_id, producer ORDER BY available_at DESC, snapshot_id DESC) = 1""",
    ),
)
def latest_per_key(spark, folder):
    rows = ct.with_document(_snaps(spark, folder), SPEC).select(
        "case_id", F.col("producer_system").alias("producer"), "snapshot_id", "available_at", F.col("doc_state").alias("state")
    )
    return ct.latest_per_key(rows, ["case_id", "producer"], ct.SNAPSHOT_ORDER)


_LATEST = """latest AS (SELECT case_id, producer, snapshot_id, state FROM sn
  QUALIFY row_number() OVER (PARTITION BY case_id, producer ORDER BY available_at DESC, snapshot_id DESC) = 1)"""


@query(
    "join_producer_pairs",
    with_(
        SNAP + ", " + _LATEST,
        """SELECT a.case_id, a.producer AS left_producer, b.producer AS right_producer, a.state AS left_state, b.state AS right_state
FROM latest a JOIN latest b ON a.case_id = b.case_id AND a.producer < b.producer AND a.state <> b.state""",
    ),
)
def join_producer_pairs(spark, folder):
    rows = ct.with_document(_snaps(spark, folder), SPEC).select(
        "case_id", "producer_system", "snapshot_id", "available_at", "doc_state"
    )
    got = ct.producer_pairs(ct.latest_per_key(rows, ["case_id", "producer_system"], ct.SNAPSHOT_ORDER))
    return got.select("case_id", "left_producer", "right_producer", "left_state", "right_state")


@query(
    "join_known_ids",
    with_(
        SNAP,
        """SELECT s.snapshot_id, s.superseded FROM sn s WHERE superseded IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM sn o WHERE o.case_id = s.case_id AND o.snapshot_id = s.superseded)""",
    ),
)
def join_known_ids(spark, folder):
    rows = _snaps(spark, folder)
    ids = rows.select("case_id", F.col("snapshot_id").alias("superseded_snapshot_id"))
    lost = rows.where(F.col("superseded_snapshot_id").isNotNull()).join(
        ids, ["case_id", "superseded_snapshot_id"], "left_anti"
    )
    return lost.select("snapshot_id", F.col("superseded_snapshot_id").alias("superseded"))


@query(
    "precedence",
    with_(
        SNAP,
        """SELECT source_system, freshness = 'fresh' AND conflict <> 'detected' AS usable,
  CASE source_system WHEN 'referral_portal' THEN 0 WHEN 'secure_email' THEN 1 WHEN 'manual_entry' THEN 2 ELSE 3 END AS source_rank,
  count(*) AS snapshots FROM sn GROUP BY 1, 2, 3""",
    ),
)
def precedence(spark, folder):
    got = ct.precedence(_snaps(spark, folder), SPEC)
    return got.groupBy("source_system", "usable", F.col("source_rank").cast("long").alias("source_rank")).agg(
        F.count(F.lit(1)).alias("snapshots")
    )


@query(
    "state_semantics",
    with_(
        SNAP,
        "SELECT state, CASE state "
        + " ".join(f"WHEN '{s}' THEN {str(f[0]).lower()}" for s, f in vocab.FIELD_STATES.items())
        + " END AS recommendation_permitted, CASE state "
        + " ".join(f"WHEN '{s}' THEN {str(f[5]).lower()}" for s, f in vocab.FIELD_STATES.items())
        + " END AS resolved, count(*) AS snapshots FROM sn GROUP BY 1, 2, 3",
    ),
)
def state_semantics(spark, folder):
    rows = ct.with_document(_snaps(spark, folder), SPEC).withColumnRenamed("doc_state", "state")
    return (
        rows.join(F.broadcast(ct.state_semantics(spark)), "state")
        .groupBy("state", "recommendation_permitted", "resolved")
        .agg(F.count(F.lit(1)).alias("snapshots"))
    )


CONTRA = (
    SNAP
    + ", "
    + _LATEST
    + """,
seq AS (
  SELECT *, lag(snapshot_id) OVER w AS prev_id, lag(version) OVER w AS prev_version,
    last_value(CASE WHEN state = 'present' AND conflict = 'none' THEN snapshot_id END IGNORE NULLS) OVER (PARTITION BY case_id
      ORDER BY available_at, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resolved_id
  FROM sn WINDOW w AS (PARTITION BY case_id ORDER BY available_at, snapshot_id)
),
con AS (
  SELECT 'not_applicable_with_missing_warning' AS type, case_id, snapshot_id AS first_id, CAST(NULL AS VARCHAR) AS second_id
  FROM sn WHERE state = 'not_applicable' AND warned
  UNION ALL SELECT 'review_complete_before_availability', case_id, snapshot_id, NULL FROM sn
    WHERE review = 'completed' AND source_event_at > available_at
  UNION ALL SELECT 'non_monotonic_supersession', case_id, prev_id, snapshot_id FROM seq WHERE version < prev_version
  UNION ALL SELECT 'warning_after_resolution', case_id, resolved_id, snapshot_id FROM seq WHERE resolved_id IS NOT NULL AND warned
  UNION ALL SELECT 'producer_disagreement', a.case_id, a.snapshot_id, b.snapshot_id FROM latest a JOIN latest b
    ON a.case_id = b.case_id AND a.producer < b.producer AND a.state <> b.state
)"""
)


@query("contradictions", with_(CONTRA, "SELECT * FROM con"))
def contradictions(spark, folder):
    return ct.contradictions(_snaps(spark, folder), SPEC, _scale(spark, folder))


@query("contradiction_counts", with_(CONTRA, "SELECT type, count(*) AS contradictions FROM con GROUP BY 1"))
def contradiction_counts(spark, folder):
    return ct.contradiction_counts(ct.contradictions(_snaps(spark, folder), SPEC, _scale(spark, folder)))


_CODES = {
    "unsupported_form_contract": "form_no IS NULL",
    "requirements_version_mismatch": "contract <> 'requirements-v2'",
    "absent_producer": "trim(producer) = ''",
    "invalid_supersession": "update_type = 'supersession' AND superseded IS NULL",
    "missing_declaration": "declaration = 'other'",
    "unsupported_field_identifier": "extra",
    "impossible_field_state": "state = 'not_applicable' AND applies",
}
FOUND = (
    CONTRA
    + """,
fnd AS (
  SELECT 'duplicate_snapshot' AS code, snapshot_id FROM (SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id
    ORDER BY available_at) AS r FROM sn) WHERE r > 1
  UNION ALL """
    + " UNION ALL ".join(f"SELECT '{c}', snapshot_id FROM fm WHERE {w}" for c, w in _CODES.items())
    + """
  UNION ALL SELECT 'out_of_order_source_version', snapshot_id FROM seq WHERE version < prev_version
  UNION ALL SELECT 'unknown_superseded_snapshot', s.snapshot_id FROM sn s WHERE superseded IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM sn o WHERE o.case_id = s.case_id AND o.snapshot_id = s.superseded)
)"""
)


@query(
    "snapshot_validation",
    with_(
        FOUND,
        f"""SELECT code, occurrences, CASE WHEN code IN {q.quoted(ct.ERROR_CODES)} THEN 'error' ELSE 'warning' END AS severity FROM (
  SELECT code, count(*) AS occurrences FROM fnd GROUP BY 1
  UNION ALL SELECT 'source_contradiction', count(*) FROM con)""",
    ),
)
def snapshot_validation(spark, folder):
    rows, scale = _snaps(spark, folder), _scale(spark, folder)
    found = ct.snapshot_findings(rows, sn.contract_forms(spark), SPEC, scale)
    return ct.snapshot_validation(found, ct.contradictions(rows, SPEC, scale))


@query(
    "snapshot_references",
    with_(
        FOUND,
        """SELECT code, string_agg(snapshot_id, ',' ORDER BY snapshot_id) AS ids FROM (SELECT code, snapshot_id,
  row_number() OVER (PARTITION BY code ORDER BY snapshot_id) AS r FROM (SELECT DISTINCT code, snapshot_id FROM fnd)) WHERE r <= 20 GROUP BY 1""",
    ),
)
def snapshot_references(spark, folder):
    found = ct.snapshot_findings(_snaps(spark, folder), sn.contract_forms(spark), SPEC, _scale(spark, folder))
    return ct.finding_references(found).select("code", F.concat_ws(",", "references").alias("ids"))


_SHARES = {
    "supported_form_rate": "form_no IS NOT NULL",
    "fresh_rate": "freshness = 'fresh'",
    "stale_snapshot_rate": "freshness = 'stale'",
    "conflict_rate": "conflict = 'detected'",
    "source_warning_coverage": "warned",
    "manual_review_state_availability": "review <> 'unavailable'",
    "requirements_version_agreement": "contract = 'requirements-v2'",
    "supersession_integrity": "version = 1 OR superseded IS NOT NULL",
    "usable_input_coverage": "freshness = 'fresh' AND conflict = 'none' AND contract = 'requirements-v2' AND form_no IS NOT NULL",
    "contract_related_abstention_rate": "freshness <> 'fresh' OR conflict = 'detected' OR contract <> 'requirements-v2'",
}
_FIELD_SQL = {
    "field_state_completeness": "CASE WHEN proven THEN 2 + CAST(extra AS INT) ELSE 0 END",
    "applicability_coverage": "1 + CAST(applies IS NOT NULL AS INT)",
    "unknown_state_rate": "CAST(state IN ('unknown', 'pending_source_update') AS INT) + CAST(extra AS INT)",
    "unsupported_state_rate": "CAST(state = 'unsupported' AS INT)",
}
_GROUPS = {
    "overall": "'all'",
    "source_system": "source_system",
    "form_version": "form_version",
    "month": "strftime(available_at, '%Y-%m')",
    "producer_system": "producer",
}
_QUALITY = (
    SNAP
    + ",\ng AS ("
    + " UNION ALL ".join(f"SELECT *, '{d}' AS dimension, {v} AS value FROM fm" for d, v in _GROUPS.items())
    + ")"
)


@query(
    "contract_quality",
    with_(
        _QUALITY,
        " UNION ALL ".join(
            [
                f"SELECT dimension, value, '{n}' AS measure, round(avg(CAST({w} AS INT)), 6) AS number FROM g GROUP BY 1, 2"
                for n, w in ((n, f"({w})") for n, w in _SHARES.items())
            ]
            + [
                f"SELECT dimension, value, '{n}', round(sum({w}) / sum(2 + CAST(extra AS INT)), 6) FROM g GROUP BY 1, 2"
                for n, w in _FIELD_SQL.items()
            ]
            + [
                "SELECT dimension, value, 'mean_update_delay_minutes', "
                "round(avg(date_diff('microsecond', source_event_at, available_at) / 60000000.0), 6) FROM g GROUP BY 1, 2"
            ]
        ),
    ),
)
def contract_quality(spark, folder):
    got = ct.contract_quality(_snaps(spark, folder), sn.contract_forms(spark), SPEC)
    return tidy(got.select("dimension", "value", "measure", "number"))


@query(
    "contract_distributions",
    with_(
        SNAP,
        """SELECT series, label, state, count(*) AS snapshots FROM (
  SELECT 'freshness' AS series, freshness AS label, CAST(NULL AS VARCHAR) AS state FROM sn
  UNION ALL SELECT 'conflict', conflict, NULL FROM sn UNION ALL SELECT 'form_version', form_version, NULL FROM sn
  UNION ALL SELECT 'source_abstention', source_system, NULL FROM sn WHERE freshness <> 'fresh' OR conflict = 'detected'
  UNION ALL SELECT 'field_state', 'supporting_document', state FROM sn
  UNION ALL SELECT 'field_state', 'referral_form', 'present' FROM sn
  UNION ALL SELECT 'field_state', 'extra_field', 'unknown' FROM sn WHERE extra) GROUP BY 1, 2, 3""",
    ),
)
def contract_distributions(spark, folder):
    return ct.contract_distributions(_snaps(spark, folder))


# --- detector ----------------------------------------------------------------------
def _detected(spark, folder, as_of=None):
    return det.detect(_snaps(spark, folder), sn.contract_forms(spark), DET, _scale(spark, folder), as_of)


# the detector as a walk over each case with its state in columns
WALK = f""",
base AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY place, available_at, snapshot_id) AS p,
    EXISTS (SELECT 1 FROM placed o WHERE o.case_id = placed.case_id AND o.delivery = placed.delivery
            AND (o.place, o.available_at, o.snapshot_id) < (placed.place, placed.available_at, placed.snapshot_id)) AND update_type = 'retry' AS rep,
    CASE WHEN form_no IS NULL OR form_version NOT IN ('INTAKE-1', 'INTAKE-2')
           OR source_system NOT IN {q.quoted(vocab.CONTRACT_SOURCES)} OR contract <> 'requirements-v2' THEN 'abstain'
         WHEN conflict = 'detected' OR freshness <> 'fresh' OR applies IS NULL
           OR state IN ('unknown', 'unsupported') THEN 'abstain'
         WHEN state = 'pending_source_update' THEN 'pending'
         WHEN state IN ('present', 'not_applicable') THEN 'resolved'
         WHEN state IN ('conflicting', 'stale') THEN 'abstain'
         WHEN review IN ('started', 'completed') OR warned THEN 'observe_only'
         ELSE 'recommend' END AS b
  FROM placed
),
walk(case_id, p, active, pend, due, snapshot_id, seen_at, outcome, fired, fired_due) AS (
  SELECT case_id, CAST(0 AS BIGINT), false, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR),
    CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP)
  FROM (SELECT DISTINCT case_id FROM base)
  UNION ALL
  SELECT w.case_id, n.p,
    CASE WHEN n.rep THEN w.active WHEN n.b IN ('recommend', 'observe_only') THEN true
         WHEN n.b = 'resolved' AND n.superseded IS NOT NULL AND w.active THEN false ELSE w.active END,
    CASE WHEN n.rep THEN CASE WHEN n.place > w.due THEN NULL ELSE w.pend END
         WHEN n.b = 'pending' THEN n.snapshot_id
         WHEN n.b IN ('recommend', 'observe_only') OR (n.b = 'resolved' AND n.superseded IS NOT NULL AND w.active)
           OR n.place > w.due THEN NULL ELSE w.pend END,
    CASE WHEN n.rep THEN CASE WHEN n.place > w.due THEN NULL ELSE w.due END
         WHEN n.b = 'pending' THEN n.place + INTERVAL 180 MINUTE
         WHEN n.b IN ('recommend', 'observe_only') OR (n.b = 'resolved' AND n.superseded IS NOT NULL AND w.active)
           OR n.place > w.due THEN NULL ELSE w.due END,
    n.snapshot_id, n.available_at,
    CASE WHEN n.rep THEN 'no_recommendation'
         WHEN n.b = 'resolved' AND n.superseded IS NOT NULL AND w.active THEN 'retract'
         WHEN n.b = 'resolved' THEN 'no_recommendation' ELSE n.b END,
    CASE WHEN n.place > w.due THEN w.pend END, CASE WHEN n.place > w.due THEN w.due END
  FROM walk w JOIN base n ON n.case_id = w.case_id AND n.p = w.p + 1
),
res AS (
  SELECT case_id, snapshot_id, seen_at AS evaluated_at, outcome, false AS timeout, false AS running FROM walk WHERE p > 0
  UNION ALL SELECT case_id, fired, fired_due, 'abstain', true, false FROM walk WHERE fired IS NOT NULL
  UNION ALL SELECT case_id, pend, due, 'abstain', true, true FROM
    (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC) AS r FROM walk) WHERE r = 1 AND pend IS NOT NULL
)"""
DETECT = "RECURSIVE " + SNAP + ",\nplaced AS (SELECT *, available_at AS place FROM fm)" + WALK


@query(
    "stream_detector_batch",
    with_(DETECT, "SELECT case_id, snapshot_id, evaluated_at, outcome, timeout FROM res"),
)
def stream_detector_batch(spark, folder):
    got = _detected(spark, folder)
    return got.select(
        "case_id", "snapshot_id", "evaluated_at", "outcome", (F.col("reasons") == det.EXPIRED).alias("timeout")
    )


@query("dedup_delivery", with_(DETECT, "SELECT case_id, snapshot_id FROM base WHERE rep"))
def dedup_delivery(spark, folder):
    return _detected(spark, folder).where(F.col("reasons") == det.REPEATED).select("case_id", "snapshot_id")


@query("stream_confirm_timer", with_(DETECT, "SELECT case_id, snapshot_id, evaluated_at AS due_at FROM res WHERE timeout"))
def stream_confirm_timer(spark, folder):
    return _detected(spark, folder).where(F.col("reasons") == det.EXPIRED).select("case_id", "snapshot_id", "due_at")


@query("stream_retract", with_(DETECT, "SELECT case_id, snapshot_id, evaluated_at FROM res WHERE outcome = 'retract'"))
def stream_retract(spark, folder):
    return _detected(spark, folder).where(F.col("outcome") == "retract").select("case_id", "snapshot_id", "evaluated_at")


@query(
    "detector_states",
    with_(
        DETECT,
        """SELECT case_id, bool_or(outcome IN ('recommend', 'observe_only')) AS positive, bool_or(outcome = 'retract') AS retracted,
  bool_or(timeout) AS confirmation_miss, count(*) AS evaluations,
  coalesce((SELECT active FROM walk w WHERE w.case_id = res.case_id ORDER BY p DESC LIMIT 1), false) AS active FROM res GROUP BY case_id""",
    ),
)
def detector_states(spark, folder):
    return det.final_states(_detected(spark, folder))


# Cases ordered by id as the surfaced ones: at most 12 active recommendations.
@query(
    "topk_capacity",
    with_(
        DETECT,
        """SELECT case_id FROM (SELECT case_id, max_by(outcome, (p)) FILTER (WHERE outcome IN ('recommend', 'observe_only', 'retract')) AS o
  FROM walk GROUP BY 1) WHERE o <> 'retract' ORDER BY case_id LIMIT 12""",
    ),
)
def topk_capacity(spark, folder):
    from ..operators.review import topk_capacity as capped

    states = det.final_states(_detected(spark, folder)).where("active")
    got = capped(states.withColumn("queue", F.lit("all")), ["queue"], ["case_id"], 12, _scale(spark, folder))
    return got.select("case_id")


OBSERVE = (
    DETECT
    + LAB
    + """,
st AS (SELECT case_id, bool_or(outcome IN ('recommend', 'observe_only')) AS detected,
  coalesce(bool_or(outcome = 'recommend'), false) AS surfaced, bool_or(timeout) AS miss FROM res GROUP BY 1),
fst AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY available_at, snapshot_id) AS r FROM fm),
per AS (
  SELECT f.*, (SELECT min(available_at) FROM fm x WHERE x.case_id = f.case_id AND x.applies AND x.state IN ('absent', 'verification_required')
      AND x.contract = 'requirements-v2' AND x.freshness = 'fresh' AND x.conflict <> 'detected') AS usable_at,
    (SELECT min(available_at) FROM fm x WHERE x.case_id = f.case_id AND x.review IN ('started', 'completed')) AS review_at,
    coalesce((SELECT max_by(l.status, (l.valid_from, l.label_id)) FROM lab l WHERE l.case_id = f.case_id AND l.valid_from <= f.available_at
      AND (l.valid_until IS NULL OR f.available_at < l.valid_until)), 'not_evaluable') AS label
  FROM fst f WHERE r = 1
),
ob AS (
  SELECT *, usable_at IS NOT NULL AS observable, coalesce(usable_at <= useful, false) AS timely,
    CASE WHEN form_no IS NULL OR contract <> 'requirements-v2' THEN 'unsupported_form_contract'
      WHEN conflict = 'detected' THEN 'conflicting_source_state' WHEN freshness <> 'fresh' THEN 'stale_source_state'
      WHEN usable_at > useful THEN 'evidence_arrived_too_late' WHEN applies IS NULL THEN 'conditional_applicability_unknown'
      WHEN state IN ('unknown', 'pending_source_update') THEN 'unknown_absent_ambiguity'
      WHEN usable_at IS NULL THEN 'source_evidence_unavailable' WHEN miss THEN 'confirmation_window_miss'
      WHEN NOT detected THEN 'detector_rule_miss' WHEN NOT surfaced THEN 'capacity_not_surfaced' ELSE 'detected' END AS category
  FROM (SELECT *, least(available_at + INTERVAL 120 MINUTE, coalesce(review_at, available_at + INTERVAL 120 MINUTE)) AS useful
        FROM per JOIN st USING (case_id) WHERE label = 'positive')
)"""
)


def _observed(spark, folder):
    e = table(spark, folder, "events")
    results = _detected(spark, folder)
    outcomes = results.groupBy("case_id").agg(
        F.bool_or(F.col("outcome").isin("recommend", "observe_only")).alias("detected"),
        F.bool_or(F.col("outcome") == "recommend").alias("surfaced"),
        F.bool_or(F.col("reasons") == det.EXPIRED).alias("confirmation_miss"),
    )
    return ct.observability(
        sn.snapshots(e), sn.label_intervals(e), sn.contract_forms(spark), outcomes, SPEC
    )


@query(
    "observability_taxonomy",
    with_(
        OBSERVE,
        """SELECT case_id, category, useful AS latest_useful_at, observable, timely,
  CASE WHEN category IN ('conflicting_source_state', 'stale_source_state') THEN 'policy_prohibited'
    WHEN detected AND timely THEN 'observable_and_detected' WHEN timely THEN 'observable_but_missed'
    WHEN observable THEN 'observable_too_late'
    WHEN category IN ('unknown_absent_ambiguity', 'conditional_applicability_unknown') THEN 'partially_observable'
    ELSE 'unobservable' END AS status FROM ob""",
    ),
)
def observability_taxonomy(spark, folder):
    return _observed(spark, folder).select("case_id", "category", "latest_useful_at", "observable", "timely", "status")


_CEIL = {
    "overall": "'all'",
    "source_system": "source_system",
    "form_version": "form_version",
    "freshness": "freshness",
    "form_support": "CASE WHEN form_no IS NULL THEN 'unsupported' ELSE 'supported' END",
    "manual_review": "review",
}


def _ceilings_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, {v} AS value, count(*) AS positives, count(*) FILTER (WHERE observable) AS observable,
  count(*) FILTER (WHERE timely) AS timely, count(*) FILTER (WHERE surfaced) AS surfaced,
  round(count(*) FILTER (WHERE observable) / count(*), 6) AS contract_ceiling,
  round(count(*) FILTER (WHERE detected) / count(*), 6) AS detected_recall FROM ob GROUP BY 2"""
        for d, v in _CEIL.items()
    )


@query("recall_ceilings", with_(OBSERVE, _ceilings_sql()))
def recall_ceilings(spark, folder):
    got = ct.recall_ceilings(_observed(spark, folder))
    return tidy(
        got.select(
            "dimension", "value", "positives", "observable", "timely", "surfaced", "contract_ceiling", "detected_recall"
        )
    )


@query(
    "recall_funnel",
    with_(
        OBSERVE,
        """SELECT 'hidden_positives' AS stage, count(*) AS cases FROM ob UNION ALL SELECT 'observable', count(*) FROM ob WHERE observable
UNION ALL SELECT 'observable_in_time', count(*) FROM ob WHERE timely UNION ALL SELECT 'policy_permitted', count(*) FROM ob WHERE observable
UNION ALL SELECT 'surfaced', count(*) FROM ob WHERE surfaced""",
    ),
)
def recall_funnel(spark, folder):
    return ct.recall_funnel(ct.recall_ceilings(_observed(spark, folder)))


@query(
    "intersect_positive",
    with_(
        OBSERVE,
        "SELECT count(*) AS positives, count(*) FILTER (WHERE detected) AS detected, "
        "count(*) FILTER (WHERE detected AND observable) AS detected_and_observable FROM ob",
    ),
)
def intersect_positive(spark, folder):
    return _observed(spark, folder).agg(
        F.count(F.lit(1)).alias("positives"),
        F.count_if("detected").alias("detected"),
        F.count_if(F.col("detected") & F.col("observable")).alias("detected_and_observable"),
    )


# --- streams -------------------------------------------------------------------------
def _stream(spark, folder):
    return sn.snapshots(mo.stream_table(spark, folder, "events"))


@query(
    "stream_detector",
    with_(
        DETECT,
        """SELECT case_id, snapshot_id, evaluated_at, outcome, timeout FROM res
WHERE NOT timeout OR date_trunc('milliseconds', evaluated_at + INTERVAL 1 MILLISECOND) <= (SELECT max(ts) FROM events)""",
    ),
)
def stream_detector(spark, folder):
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        got = mo.run_to_end(det.detect_stream(_stream(spark, folder), sn.contract_forms(spark), DET))
    return got.select(
        "case_id", "snapshot_id", "evaluated_at", "outcome", (F.col("reasons") == det.EXPIRED).alias("timeout")
    )


@query(
    "stream_retry_dedup",
    with_(SNAP, "SELECT delivery, 1 AS rows FROM sn GROUP BY 1"),
)
def stream_retry_dedup(spark, folder):
    # a retry comes within a day; older state goes with the watermark
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        got = mo.run_to_end(mo.retry_dedup(_stream(spark, folder), "1 day"))
    return got.groupBy(
        F.concat_ws("|", "source_record_identifier", F.col("source_record_version").cast("string")).alias("delivery")
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_tumbling_quality",
    with_(
        SNAP,
        """SELECT time_bucket(INTERVAL 7 DAY, available_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS snapshots,
  count(*) FILTER (WHERE freshness = 'fresh') AS fresh, count(*) FILTER (WHERE conflict = 'detected') AS conflicts,
  count(*) FILTER (WHERE warned) AS warned FROM sn GROUP BY 1""",
    ),
)
def stream_tumbling_quality(spark, folder):
    emitted = mo.run_to_end(mo.tumbling_quality(_stream(spark, folder)), "update")
    return mo.latest_update(emitted, ["window_start"])


# late: older than the newest source time that the case has seen; 30 minutes late is still put in order
LATE = replace(DET, event_time="source_event_at", allowed_lateness_minutes=30)
POLICIES = ("apply_with_warning", "abstain")
PLACED = (
    "RECURSIVE "
    + SNAP
    + """,
arrived AS (
  SELECT *, max(source_event_at) OVER (PARTITION BY case_id ORDER BY available_at, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM fm
),
judged AS (
  SELECT *, coalesce(source_event_at < mark, false) AS late, coalesce(source_event_at < mark - INTERVAL 30 MINUTE, false) AS beyond FROM arrived
),
placed AS (
  SELECT * REPLACE (policy || '|' || case_id AS case_id), CASE WHEN beyond THEN mark ELSE source_event_at END AS place
  FROM judged, (SELECT unnest(['apply_with_warning', 'abstain']) AS policy) WHERE policy <> 'abstain' OR NOT beyond
)"""
)


def _arrivals(spark, folder, policy):
    """The detector over snapshots that arrive in three portions, judged by their source time."""
    spec = replace(LATE, late_policy=policy)
    forms = sn.contract_forms(spark)
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        return mo.replay(_snaps(spark, folder), "available_at", 3, lambda rows: det.detect_stream(rows, forms, spec)), spec


@query(
    "stream_late_policy",
    with_(
        PLACED + WALK,
        """SELECT split_part(r.case_id, '|', 1) AS policy, split_part(r.case_id, '|', 2) AS case_id, r.snapshot_id, evaluated_at, outcome, timeout,
  NOT timeout AND coalesce(late, false) AS late
FROM res r LEFT JOIN base b ON b.case_id = r.case_id AND b.snapshot_id = r.snapshot_id AND b.available_at = r.evaluated_at
WHERE NOT running OR date_trunc('milliseconds', evaluated_at + INTERVAL 1 MILLISECOND) <= (SELECT max(ts) FROM events)
UNION ALL SELECT 'abstain', case_id, snapshot_id, available_at, 'abstain', false, true FROM judged WHERE beyond""",
    ),
)
def stream_late_policy(spark, folder):
    """The last word of the stream on every evaluation, corrections done, under both policies."""
    found = []
    for policy in POLICIES:
        emitted, _ = _arrivals(spark, folder, policy)
        found.append(det.settled(emitted).withColumn("policy", F.lit(policy)))
    return reduce(DataFrame.unionByName, found).select(
        "policy", "case_id", "snapshot_id", "evaluated_at", "outcome", F.col("reasons").eqNullSafe(det.EXPIRED).alias("timeout"), "late"
    )


@query(
    "stream_late_arrivals",
    with_(
        PLACED,
        """SELECT policy, case_id, snapshot_id, available_at AS arrived_at, source_event_at AS event_at, mark,
  date_diff('microsecond', source_event_at, mark) / 60000000.0 AS behind_minutes,
  CASE WHEN NOT beyond THEN 'placed_by_event_time' WHEN policy = 'abstain' THEN 'abstained' ELSE 'applied_with_warning' END AS done
FROM judged, (SELECT unnest(['apply_with_warning', 'abstain']) AS policy) WHERE late""",
    ),
)
def stream_late_arrivals(spark, folder):
    """The stream's second output: the late rows, what they were behind of, and what was done with them."""
    found = []
    for policy in POLICIES:
        emitted, spec = _arrivals(spark, folder, policy)
        found.append(det.late_arrivals(emitted, spec).withColumn("policy", F.lit(policy)))
    return reduce(DataFrame.unionByName, found)


# every fact by the time it happened and by the time it was known, asked for two times of knowledge
AS_OF = (datetime(2024, 1, 12, 12), datetime(2024, 1, 24, 12))


@query(
    "stream_watermark",
    with_(
        q.EV,
        """SELECT a AS as_of, event_type AS status, count(*) AS cases, sum(n)::BIGINT AS facts FROM (
  SELECT a, case_id, max_by(event_type, (event_at, event_id)) AS event_type, count(*) AS n
  FROM ev, (SELECT unnest([TIMESTAMP '2024-01-12 12:00:00', TIMESTAMP '2024-01-24 12:00:00']) AS a) WHERE ingested_at <= a GROUP BY 1, 2)
GROUP BY 1, 2""",
    ),
)
def stream_watermark(spark, folder):
    """Status of each case as it was known at two times, read from the state of the stream that keeps the facts."""
    facts = session_events(spark, folder).select(
        "case_id", F.col("event_id").alias("id"), "event_at", F.col("ingested_at").alias("known_at"), F.col("event_type").alias("status")
    )
    place = mo.new_folder(spark, "history")
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        mo.replay(facts, "known_at", 3, asof.remember, checkpoint=place)
        known = asof.facts_known(spark, place)
    found = []
    for time in AS_OF:
        at = F.lit(time).cast("timestamp")
        rows = asof.as_of(known, at).groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.sum("facts").alias("facts"))
        found.append(rows.withColumn("as_of", at))
    return reduce(DataFrame.unionByName, found)


@query(
    "stream_expiry",
    """WITH marks AS (SELECT *, lead(ts) OVER w AS next_at, lead(event_type) OVER w AS next_kind FROM events
  WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS draft_id, CAST(user_id AS VARCHAR) AS owner, ts AS created_at, ts + INTERVAL 8 HOUR AS expires_at
FROM marks WHERE event_type = 'view' AND (next_kind IS NULL OR next_kind = 'view' OR next_at >= ts + INTERVAL 8 HOUR)
  AND date_trunc('milliseconds', ts + INTERVAL 8 HOUR + INTERVAL 1 MILLISECOND) <= (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click'))""",
)
def stream_expiry(spark, folder):
    """A view opens a draft, a click decides on the user's latest one; what is undecided after 8 hours expires."""
    marks = mo.stream_table(spark, folder, "events").where("event_type in ('view', 'click')").select(
        F.col("user_id").cast("string").alias("owner"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.when(F.col("event_type") == "view", timers.OPENED).otherwise(timers.DECIDED).alias("kind"),
        F.col("ts").alias("at"),
    )
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        return mo.run_to_end(timers.expired_drafts(marks, 8)).drop("batch")


@query(
    "stream_stuck",
    """WITH steps AS (SELECT CAST(user_id AS VARCHAR) AS case_id, ts, event_type = 'purchase' AS ended,
    lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS next_at
  FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))
SELECT case_id, ts AS progress_at, ts + INTERVAL 48 HOUR AS stuck_at FROM steps
WHERE NOT ended AND (next_at IS NULL OR next_at > ts + INTERVAL 48 HOUR)
  AND date_trunc('milliseconds', ts + INTERVAL 48 HOUR + INTERVAL 1 MILLISECOND) <=
    (SELECT max(ts) FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase'))""",
)
def stream_stuck(spark, folder):
    """A user is a case that views, clicks and signups move on and a purchase ends."""
    rows = mo.stream_table(spark, folder, "events").where("event_type in ('view', 'click', 'signup', 'purchase')")
    rows = rows.select(F.col("user_id").cast("string").alias("case_id"), "event_type", F.col("ts").alias("event_at"))
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        return mo.run_to_end(timers.stuck(rows, ("view", "click", "signup"), ("purchase",), 48)).drop("batch")


@query(
    "sessionise_window",
    with_(q.EV, "SELECT user_id, min(event_at) AS first_at, max(event_at) AS last_at, count(*) AS events FROM ev GROUP BY user_id, session_no"),
)
def sessionise_window(spark, folder):
    """Sessions as a stream merges them from events that arrive in the order of their ingestion, up to 21 days late."""
    rows = session_events(spark, folder).select("user_id", F.col("event_at").alias("ts"), "ingested_at")
    # a row of nobody, long after the last one, ends the replay
    late = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"), F.col("ts").alias("ingested_at")
    )
    # session_window closes a session at the gap itself; one microsecond keeps "longer than" the gap
    merge = lambda arrived: mo.sessions(arrived, "user_id", "ts", "12 hours 1 microsecond", "21 days")
    return mo.replay(rows, "ingested_at", 4, merge, closing=late).where("user_id is not null").drop("batch")


# --- going on from a checkpoint
CUT = datetime(2024, 1, 16)


@query(
    "stream_checkpoint",
    with_(
        DETECT,
        """SELECT CASE WHEN evaluated_at < TIMESTAMP '2024-01-16' THEN 'first run' ELSE 'second run' END AS run, outcome AS what, count(*) AS n
FROM res WHERE NOT timeout GROUP BY ALL
UNION ALL SELECT 'cases kept', CASE WHEN a THEN 'active' ELSE 'not active' END, count(*) FROM
  (SELECT case_id, coalesce(arg_max(active, p), false) AS a FROM walk WHERE p > 0 GROUP BY 1) GROUP BY ALL
UNION ALL SELECT 'refused', unnest(['detector', 'policy', 'source']), 1""",
    ),
)
def stream_checkpoint(spark, folder):
    """Two runs on one checkpoint with new files between them, a third without, and three that are refused."""
    rows, forms = _snaps(spark, folder), sn.contract_forms(spark)
    place, source = mo.new_folder(spark, "resume"), mo.new_folder(spark, "arrived")
    cut = F.lit(CUT).cast("timestamp")
    versions = resume.Versions.of(DET, rows, "snapshots")

    def run(with_versions) -> DataFrame:
        resume.check(spark, place, with_versions)
        arrived = spark.readStream.schema(rows.schema).parquet(source)
        return mo.run_to_end(det.detect_stream(arrived, forms, DET, versions=astuple(with_versions)), checkpoint=place)

    emitted = []
    with mo.state_store(spark, rows=_scale(spark, folder).rows):
        for name, part in (("first run", F.col("available_at") < cut), ("second run", F.col("available_at") >= cut), ("third run", None)):
            if part is not None:
                rows.where(part).write.mode("append").parquet(source)
            emitted.append(run(versions).where(~F.col("reasons").eqNullSafe(det.EXPIRED)).select(F.lit(name).alias("run"), F.col("outcome").alias("what")))
        refused = []
        for other in ("detector", "policy", "source"):
            try:
                run(replace(versions, **{other: "another"}))
            except resume.VersionMismatch as mismatch:
                refused.append(("refused", str(mismatch).rsplit(" ", 1)[1]))
        kept = resume.checkpoint_record(spark, place)
    emitted.append(kept.select(F.lit("cases kept").alias("run"), F.when(F.col("active"), "active").otherwise("not active").alias("what")))
    emitted.append(spark.createDataFrame(refused, "run string, what string"))
    return reduce(DataFrame.unionByName, emitted).groupBy("run", "what").agg(F.count(F.lit(1)).alias("n"))
