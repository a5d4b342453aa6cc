"""Registered queries: validation, joins, timelines and case metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import vocab
from ..functions.calendar import business_hours, hours_between
from ..functions.ordered import scan
from ..operators import mining, quality, timeline
from ..operators.intervals import fifo_pairs, merge_intervals, next_match
from ..operators.metrics import BOOLEAN_METRICS, METRICS, metric_provenance, metrics_long
from ..sources.tables import (
    order_log,
    session_cases,
    session_events,
    session_log,
    table,
    table_scale,
    turn_log,
)
from ..spec import BaselineSpec, ContractSpec
from . import sql as q
from .registry import joined, query, tidy
from .sql import with_
from .workspace import BASELINE, UTC, Workspace

_V = ", "


@query(
    "normalise_utc",
    "SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_text FROM events",
)
def normalise_utc(spark, folder):
    e = table(spark, folder, "events")
    return e.select(
        "event_id", F.unix_micros("ts").alias("micros"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc_text")
    )


@query(
    "sessionise",
    with_(q.EV, "SELECT event_id, case_id, event_type, actor_type, actor_id, source_system, ingested_at FROM ev"),
)
def sessionise(spark, folder):
    return session_events(spark, folder).select(
        "event_id", "case_id", "event_type", "actor_type", "actor_id", "source_system", "ingested_at"
    )


_CASE_RULES = {
    "identifier_pattern": "NOT regexp_matches(external_source_id, '^CASE-[A-Z0-9]{4,32}$')",
    "terminal_without_closed_at": f"status IN {q.quoted(vocab.TERMINAL_STATUSES)} AND closed_at IS NULL",
    "closed_at_without_terminal": f"status NOT IN {q.quoted(vocab.TERMINAL_STATUSES)} AND closed_at IS NOT NULL",
    "closed_before_received": "closed_at < received_at",
    "updated_before_created": "updated_at < created_at",
}


@query(
    "validate_case_rows",
    with_(
        q.CASES,
        "SELECT code, count(*) AS rows FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS code FROM cases WHERE {w}" for c, w in _CASE_RULES.items())
        + ") GROUP BY 1",
    ),
)
def validate_case_rows(spark, folder):
    cases = session_cases(session_events(spark, folder))
    return quality.violation_counts(quality.validate_case_rows(cases, r"^CASE-[A-Z0-9]{4,32}$"))


_PAIRS = ", ".join(f"('{e}', '{r}')" for e, rs in vocab.REASONS_BY_EVENT.items() for r in rs)
_NEEDY = q.quoted(vocab.REASONS_BY_EVENT)


@query(
    "validate_event_rows",
    with_(
        q.EV,
        f"""SELECT code, count(*) AS rows FROM (
  SELECT 'external_id_pattern' AS code FROM ev
  WHERE NOT regexp_matches(external_event_id, '^[A-Z0-9][A-Z0-9._:-]{{5,127}}$')
  UNION ALL SELECT 'reason_required' FROM ev WHERE event_type IN {_NEEDY} AND reason_code IS NULL
  UNION ALL SELECT 'reason_not_allowed' FROM ev WHERE event_type IN {_NEEDY} AND reason_code IS NOT NULL
    AND (event_type, reason_code) NOT IN ({_PAIRS})
  UNION ALL SELECT 'actor_id_required' FROM ev
  WHERE actor_type IN {q.quoted(vocab.INTERNAL_ACTORS)} AND actor_id IS NULL
) GROUP BY 1""",
    ),
)
def validate_event_rows(spark, folder):
    checked = quality.validate_event_rows(session_events(spark, folder), quality.reason_rules(spark))
    return quality.violation_counts(checked)


@query(
    "forbidden_key_scan",
    "SELECT 'events' AS source, count(*) AS rows, "
    "count(*) FILTER (WHERE regexp_matches(lower(props), '\"(address|email|diagnosis|k)\"\\s*:')) AS flagged FROM events",
)
def forbidden_key_scan(spark, folder):
    # `k` is the only key the table has, so it is added to the list to be found
    keys = (*vocab.FORBIDDEN_KEYS, "k")
    got = quality.forbidden_key_scan(table(spark, folder, "events"), "props", keys)
    return got.agg(
        F.lit("events").alias("source"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("forbidden_keys") > 0).alias("flagged"),
    )


def _text_sql(name: str, ident: str, column: str) -> str:
    tests = [f"SELECT {ident} AS id, 'term:{t}' AS finding FROM {name} WHERE contains(lower({column}), '{t}')"
             for t in vocab.FORBIDDEN_TERMS]
    patterns = {
        "phone": r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b",
        "email": r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}",
        "identifier": r"\b(?:nhs|patient)\s*(?:number|name|id)\s*[:=]",
    }
    tests += [
        f"SELECT {ident}, 'pattern:{n}' FROM {name} WHERE regexp_matches(lower({column}), '{p}')"
        for n, p in patterns.items()
    ]
    return " UNION ALL ".join(tests)


@query("text_safety_scan", f"SELECT * FROM ({_text_sql('documents', 'doc_id', 'text')})")
def text_safety_scan(spark, folder):
    got = quality.text_safety_scan(table(spark, folder, "documents"), "text")
    return got.select(F.col("doc_id").alias("id"), F.explode("findings").alias("finding"))


@query("text_safety_scan_pages", f"SELECT * FROM ({_text_sql('pages', 'page_id', 'html')})")
def text_safety_scan_pages(spark, folder):
    got = quality.text_safety_scan(table(spark, folder, "pages"), "html")
    return got.select(F.col("page_id").alias("id"), F.explode("findings").alias("finding"))


_PERIOD = BaselineSpec(
    cutoff=datetime(2024, 2, 15),
    calendar=UTC,
    period_start=datetime(2024, 1, 8),
    period_end=datetime(2024, 1, 22),
)


@query(
    "filter_period",
    with_(
        q.CASES,
        "SELECT count(*) FILTER (WHERE p) AS included_cases, count(*) FILTER (WHERE NOT p) AS excluded_cases FROM "
        "(SELECT received_at >= TIMESTAMP '2024-01-08' AND received_at < TIMESTAMP '2024-01-22' AS p FROM cases)",
    ),
)
def filter_period(spark, folder):
    return timeline.period_counts(session_log(spark, folder).cases, _PERIOD)


@query(
    "filter_supported_schema",
    with_(
        q.TL,
        "SELECT case_id FROM cases c WHERE schema_version = 1 "
        "AND case_id NOT IN (SELECT case_id FROM tl WHERE schema_version <> 1)",
    ),
)
def filter_supported_schema(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return timeline.filter_supported(ws.flags, ws.spec).select("case_id")


@query(
    "map_activity",
    with_(q.EV, f"SELECT activity, count(*) AS events FROM (SELECT {q._LABELS} AS activity FROM ev) GROUP BY 1"),
)
def map_activity(spark, folder):
    got = mining.map_activity(session_events(spark, folder), mining.activity_mapping(spark))
    return got.groupBy("activity").agg(F.count(F.lit(1)).alias("events"))


@query(
    "except_missing",
    with_(
        q.EV,
        "SELECT event_type, count(*) AS events FROM ev WHERE event_type NOT IN "
        "('referral_submitted', 'referral_received') GROUP BY 1",
    ),
)
def except_missing(spark, folder):
    # a mapping of two labels only, so that every other type is reported
    few = {k: vocab.ACTIVITY_LABELS[k] for k in ("referral_submitted", "referral_received")}
    return mining.unmapped_types(session_events(spark, folder), mining.activity_mapping(spark, few))


@query(
    "project_event_log",
    with_(
        q.PL,
        "SELECT case_id, event_id, activity, CAST(pos AS INT) AS pos, event_at, manual, actor_type, owner, "
        "status, referral_source, service_line FROM pl",
    ),
)
def project_event_log(spark, folder):
    return Workspace.of_sessions(spark, folder).plog.select(
        "case_id", "event_id", "activity", "pos", "event_at", "manual", "actor_type", "owner",
        "status", "referral_source", "service_line",
    )


@query(
    "join_case_events",
    """SELECT o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation, event_type,
  count(*) AS events, min(event_at) AS first_at, max(event_at) AS last_at
FROM (SELECT o_orderkey AS case_id, 'placed' AS event_type, o_orderdate AS event_at FROM orders
      UNION ALL SELECT l_orderkey, 'shipped', l_shipdate FROM lineitem) e
JOIN orders ON e.case_id = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def join_case_events(spark, folder):
    log = order_log(spark, folder)
    got = timeline.join_case_events(log.events, log.cases, "priority", "segment", "nation")
    return got.groupBy(
        F.col("case_priority").alias("priority"),
        F.col("case_segment").alias("segment"),
        F.col("case_nation").alias("nation"),
        "event_type",
    ).agg(
        F.count(F.lit(1)).alias("events"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at")
    )


@query(
    "anti_orphans",
    with_(q.CASES, "SELECT event_id, case_id FROM ev WHERE case_id NOT IN (SELECT case_id FROM cases)"),
)
def anti_orphans(spark, folder):
    log = session_log(spark, folder)
    return timeline.orphan_events(log.events, log.cases).select("event_id", "case_id")


@query(
    "anti_empty_cases",
    "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN "
    "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def anti_empty_cases(spark, folder):
    log = order_log(spark, folder)
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("case_id")
    )
    return timeline.empty_cases(returned, log.cases).select("case_id")


@query(
    "semi_selected",
    "SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey IN "
    "(SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')",
)
def semi_selected(spark, folder):
    log = order_log(spark, folder)
    picked = log.events.where("event_type = 'shipped' AND event_at >= TIMESTAMP '1998-01-01'")
    return log.cases.join(picked.select("case_id"), "case_id", "left_semi").select("case_id")


@query(
    "join_self_next",
    with_(
        q.TL,
        "SELECT event_type AS a, b, c, count(*) AS triples FROM (SELECT event_type, "
        "lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM tl "
        "WINDOW w AS (PARTITION BY case_id ORDER BY pos)) WHERE c IS NOT NULL GROUP BY ALL",
    ),
)
def join_self_next(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    one = scan(ws.rows, ["case_id"], ["pos"], ws.scale, following={"b": F.col("event_type")})
    two = scan(one, ["case_id"], ["pos"], ws.scale, following={"c": F.col("b")})
    return (
        two.where(F.col("c").isNotNull())
        .groupBy(F.col("event_type").alias("a"), "b", "c")
        .agg(F.count(F.lit(1)).alias("triples"))
    )


@query("join_fifo_pairing", with_(q.FIFO, "SELECT case_id, s AS request_at, e AS response_at FROM paired UNION ALL SELECT case_id, s, NULL FROM unpaired"))
def join_fifo_pairing(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    r = ws.spec.roles
    return fifo_pairs(ws.rows, r.request, r.response, ws.scale).select("case_id", "request_at", "response_at")


@query(
    "join_next_start",
    with_(
        q.TL,
        f"""SELECT t.case_id, t.event_id, (SELECT min_by(x.event_at, x.pos) FROM tl x WHERE x.case_id = t.case_id
  AND x.pos > t.pos AND x.event_type = '{q._IS['start']}') AS start_at FROM tl t WHERE event_type = '{q._IS['failed']}'""",
    ),
)
def join_next_start(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    r = ws.spec.roles
    return next_match(ws.rows, r.failed, r.start, "start_at", ws.scale).select("case_id", "event_id", "start_at")


@query(
    "join_prev_event",
    with_(
        q.TL,
        f"""SELECT a.case_id, a.start_at, max(t.event_at) AS assigned_at FROM
  (SELECT case_id, {q.at('start')} AS start_at, {q.at('start', 'pos')} AS p FROM tl GROUP BY 1) a
  JOIN tl t ON t.case_id = a.case_id AND t.pos < a.p AND t.event_type IN ('{q._IS['assigned']}', '{q._IS['reassigned']}')
  GROUP BY 1, 2""",
    ),
)
def join_prev_event(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    r = ws.spec.roles
    kind = F.col("event_type")
    seen = scan(
        ws.rows, ["case_id"], ["pos"], ws.scale, running={"starts": F.when(kind == r.start, 1).otherwise(0)}
    )
    owner = kind.isin(r.assigned, r.reassigned) & (F.col("starts") == 0)
    return (
        seen.groupBy("case_id")
        .agg(
            F.min(F.when(kind == r.start, F.struct("pos", "event_at")))["event_at"].alias("start_at"),
            F.max(F.when(owner, F.struct("pos", "event_at")))["event_at"].alias("assigned_at"),
        )
        .where(F.col("start_at").isNotNull() & F.col("assigned_at").isNotNull())
    )


@query(
    "timeline",
    with_(q.TL, "SELECT case_id, event_id, CAST(pos AS INT) AS pos, event_type, event_at, next_at FROM tl"),
)
def timeline_(spark, folder):
    return Workspace.of_sessions(spark, folder).rows.select(
        "case_id", "event_id", "pos", "event_type", "event_at", "next_at"
    )


@query("dedup_events", with_(q.TL, "SELECT event_id, copy_no - 1 AS copy_no FROM copies WHERE copy_no > 1"))
def dedup_events(spark, folder):
    log = session_log(spark, folder)
    known = log.events.join(log.cases.select("case_id"), "case_id", "left_semi")
    got = timeline.with_copies(known, log.scale).where(F.col("copy_no") > 0)
    return got.select("event_id", F.col("copy_no").cast("long").alias("copy_no"))


@query(
    "dedup_policy",
    with_(
        q.TL,
        "SELECT c.case_id FROM cases c WHERE schema_version = 1 "
        "AND case_id NOT IN (SELECT case_id FROM tl WHERE schema_version <> 1) "
        "AND case_id NOT IN (SELECT case_id FROM copies WHERE copy_no > 1)",
    ),
)
def dedup_policy(spark, folder):
    spec = BaselineSpec(cutoff=BASELINE.cutoff, calendar=UTC, reject_duplicates=True)
    ws = Workspace.of_sessions(spark, folder, baseline=spec)
    return timeline.filter_supported(ws.flags, spec).select("case_id")


_FLAG_SQL = """SELECT case_id, coalesce(bool_or(prev_at = event_at), false) AS identical_timestamps,
  coalesce(bool_or(ingested_at < prev_ingested), false) AS out_of_order FROM tl GROUP BY 1"""


@query("flag_identical_ts", with_(q.TL, f"SELECT case_id, identical_timestamps FROM ({_FLAG_SQL})"))
def flag_identical_ts(spark, folder):
    return Workspace.of_sessions(spark, folder).flags.select("case_id", "identical_timestamps")


@query("flag_out_of_order", with_(q.TL, f"SELECT case_id, out_of_order FROM ({_FLAG_SQL})"))
def flag_out_of_order(spark, folder):
    return Workspace.of_sessions(spark, folder).flags.select("case_id", "out_of_order")


@query(
    "last_attribute",
    with_(q.TL, "SELECT case_id, max_by(team_id, pos) FILTER (WHERE team_id IS NOT NULL) AS assigned_team FROM tl GROUP BY 1"),
)
def last_attribute(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return timeline.last_attribute(
        ws.rows, "team_id", ("clinical_team_assigned", "clinical_team_reassigned"), "assigned_team"
    )


@query("first_attribute", with_(q.TL, f"SELECT case_id, {q.at('received', 'source_system')} AS first_source FROM tl GROUP BY 1"))
def first_attribute(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    return timeline.first_attribute(ws.rows, "source_system", ("referral_received",), "first_source")


@query(
    "sort_canonical",
    "SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role AS activity "
    "FROM conversations",
)
def sort_canonical(spark, folder):
    rows = turn_log(spark, folder)
    got = scan(rows, ["case_id"], ["pos"], table_scale(spark, folder, "conversations"), position="place")
    return got.select("case_id", F.col("place").cast("long").alias("place"), "activity")


# --- one query per case metric ------------------------------------------------
_SHORT = {
    "m_case_duration": "case_duration_hours",
    "m_cycle_time": "cycle_time_hours",
    "m_manual_touches": "manual_touches",
    "m_processing_time": "processing_time_estimate_hours",
    "m_handoffs": "handoffs",
    "m_rework": "rework_count",
    "m_failed_scheduling": "failed_scheduling_attempts",
    "m_reassignments": "reassignment_count",
    "m_is_stuck": "is_stuck",
    "m_first_pass": "first_pass_complete",
    "m_time_to_check": "time_to_first_completeness_check_hours",
    "m_time_to_booking": "time_to_appointment_booking_hours",
    "m_waiting_time": "waiting_time_business_hours",
    "m_assignment_wait": "assignment_wait_business_hours",
    "m_max_ingestion_delay": "max_ingestion_delay_hours",
    "m_delayed_events": "delayed_event_count",
    "m_out_of_order": "out_of_order_ingestion",
}


def _metric_query(metric: str):
    def run(spark, folder):
        wide = Workspace.of_sessions(spark, folder).wide
        return tidy(wide.select("case_id", F.col(metric).alias("value"), F.col(f"{metric}_status").alias("status")))

    return run


for _name, _metric in _SHORT.items():
    _value = f"round({_metric}, 6)" if "hours" in _metric else _metric
    query(_name, with_(q.CM, f"SELECT case_id, {_value} AS value, {_metric}_status AS status FROM cm"))(
        _metric_query(_metric)
    )


@query(
    "case_metrics",
    with_(
        q.CM,
        "SELECT case_id, terminal_outcome, referral_source, service_line, source_system, assigned_team, "
        + ", ".join(
            (f"round({m}, 6) AS {m}" if "hours" in m else m) + f", {m}_status" for m in METRICS
        )
        + " FROM cm",
    ),
)
def case_metrics_(spark, folder):
    wide = Workspace.of_sessions(spark, folder).wide
    columns = [c for m in METRICS for c in (m, f"{m}_status")]
    return tidy(
        wide.select(
            "case_id", "terminal_outcome", "referral_source", "service_line", "source_system", "assigned_team", *columns
        )
    )


def _long_row(metric: str) -> str:
    flag = metric in BOOLEAN_METRICS
    number = "CAST(NULL AS DOUBLE)" if flag else f"round(CAST({metric} AS DOUBLE), 6)"
    return (
        f"SELECT case_id, '{metric}' AS metric, {number} AS number, {metric if flag else 'CAST(NULL AS BOOLEAN)'} AS flag, "
        f"{metric}_status AS status, CASE WHEN {metric}_status = 'calculated' THEN 'exact' "
        f"WHEN {metric}_status IN ('estimated', 'partial') THEN {metric}_status ELSE 'unavailable' END AS precision FROM cm"
    )


@query("metrics_long", with_(q.CM, " UNION ALL ".join(_long_row(m) for m in METRICS)))
def metrics_long_(spark, folder):
    got = metrics_long(Workspace.of_sessions(spark, folder).wide)
    return tidy(got.select("case_id", "metric", "number", "flag", "status", "precision"))


@query(
    "metric_provenance",
    with_(
        q.TL,
        f"""SELECT case_id, event_id, 'manual_touches' AS metric, 'source' AS role FROM tl WHERE manual
UNION ALL SELECT case_id, event_id, 'rework_count', 'source' FROM tl
  WHERE event_type IN ('{q._IS['recat']}', '{q._IS['reassigned']}', '{q._IS['failed']}')
UNION ALL SELECT case_id, event_id, 'delayed_event_count', 'source' FROM tl WHERE {q.hours('event_at', 'ingested_at')} > 24
UNION ALL SELECT case_id, r_id, 'time_to_appointment_booking_hours', 'start' FROM
  (SELECT case_id, {q.at('received', 'event_id')} AS r_id, {q.at('booked', 'event_id')} AS b_id FROM tl GROUP BY 1)
  WHERE r_id IS NOT NULL AND b_id IS NOT NULL""",
    ),
)
def metric_provenance_(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    got = metric_provenance(ws.log.events, ws.log.cases, ws.spec, ws.scale)
    keep = F.col("metric").isin("manual_touches", "rework_count", "delayed_event_count") | (
        (F.col("metric") == "time_to_appointment_booking_hours") & (F.col("role") == "start")
    )
    return got.where(keep).select("case_id", "event_id", "metric", "role")


@query(
    "business_hours",
    with_(
        q.PL,
        """SELECT event_id, round(coalesce((SELECT sum(greatest(0, date_diff('microsecond',
    greatest(event_at, d + INTERVAL 8 HOUR), least(next_at, d + INTERVAL 18 HOUR)))) FROM
    unnest(generate_series(date_trunc('day', event_at)::TIMESTAMP, next_at, INTERVAL 1 DAY)) AS g(d) WHERE isodow(d) < 6), 0)
    / 3600000000.0, 6) AS work_hours FROM edges""",
    ),
)
def business_hours_(spark, folder):
    ws = Workspace.of_sessions(spark, folder)
    pairs = mining.edges(ws.plog)
    return tidy(
        pairs.select("event_id", business_hours(F.col("event_at"), F.col("next_at"), UTC).alias("work_hours"))
    )


@query(
    "business_hours_closed",
    "SELECT o_orderkey AS case_id, l_linenumber AS line, round("
    + q.business("o_orderdate", "l_shipdate")
    + ", 6) AS work_hours FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate",
)
def business_hours_closed(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    got = orders.join(lines, orders.o_orderkey == lines.l_orderkey).where(
        F.col("l_shipdate") >= F.col("o_orderdate")
    )
    return tidy(
        got.select(
            F.col("o_orderkey").alias("case_id"),
            F.col("l_linenumber").alias("line"),
            business_hours(F.col("o_orderdate"), F.col("l_shipdate"), UTC).alias("work_hours"),
        )
    )


@query(
    "interval_merge",
    """WITH iv AS (SELECT l_suppkey AS owner, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INT)) AS e FROM lineitem),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT owner, min(s) AS start_at, max(e) AS end_at, count(*) AS merged FROM numbered GROUP BY owner, island""",
)
def interval_merge(spark, folder):
    lines = table(spark, folder, "lineitem")
    iv = lines.select(
        F.col("l_suppkey").alias("owner"),
        F.col("l_shipdate").alias("start_at"),
        F.timestamp_micros(
            F.unix_micros("l_shipdate") + F.col("l_quantity").cast("int").cast("long") * 86_400_000_000
        ).alias("end_at"),
    )
    return merge_intervals(iv, "owner", "start_at", "end_at", table_scale(spark, folder, "lineitem"))


@query(
    "case_eligibility",
    with_(
        q.CASES,
        f"""SELECT case_id, array_to_string(list_filter([
  CASE WHEN referral_source <> 'gp_practice' THEN 'outside_cohort' END,
  CASE WHEN schema_version <> 1 OR bad THEN 'unsupported_schema_version' END,
  CASE WHEN r_at IS NULL THEN 'missing_received_event' END,
  CASE WHEN c_at IS NULL THEN 'missing_check_event' END,
  CASE WHEN c_at < r_at THEN 'unsupported_event_sequence' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM cases LEFT JOIN (SELECT case_id, bool_or(schema_version <> 1) AS bad,
  min(event_at) FILTER (WHERE event_type = '{q._IS['received']}') AS r_at,
  min(event_at) FILTER (WHERE event_type = '{q._IS['check']}') AS c_at FROM ev GROUP BY 1) USING (case_id)""",
    ),
)
def case_eligibility(spark, folder):
    from ..operators.whatif import case_eligibility as eligible

    log = session_log(spark, folder)
    got = eligible(log.events, log.cases, BASELINE, ("referral_source", "gp_practice"))
    return got.select("case_id", joined("reasons").alias("reasons"))
