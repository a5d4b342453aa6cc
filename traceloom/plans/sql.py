"""SQL of the logs the registered queries read, shared by their check statements."""

from __future__ import annotations

from .. import vocab
from ..sources.tables import SESSION_TYPES


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(index: str, values) -> str:
    return f"({_list(values)})[1 + ({index}) % {len(values)}]"


def micros(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


def hours(a: str, b: str) -> str:
    return f"({micros(a, b)} / 3600000000.0)"


def business(a: str, b: str) -> str:
    """Working hours 08-18 on weekdays (UTC): difference of two cumulative counts."""

    def upto(t: str) -> str:
        us = f"(epoch_us({t}) - 345600000000)"
        day = f"({us} // 86400000000)"
        clock = f"({us} % 86400000000)"
        return (
            f"((({day}) // 7) * 5 + least(({day}) % 7, 5)) * 36000000000 + "
            f"CASE WHEN ({day}) % 7 < 5 THEN greatest(0, least({clock} - 28800000000, 36000000000)) ELSE 0 END"
        )

    return f"((({upto(b)}) - ({upto(a)})) / 3600000000.0)"


_TYPE = "CASE " + " ".join(
    f"WHEN event_type = '{raw}' AND k >= {low} THEN '{name}'"
    for raw, low, name in reversed(SESSION_TYPES)
) + " END"
_TERMINAL = quoted(vocab.TERMINAL_EVENTS)
_ACTORS = ("admin_staff", "clinical_team", "scheduling_staff", "referrer")
_INTERNAL = quoted(vocab.INTERNAL_ACTORS)

RAW = """
raw AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL
)"""

# sessions of `events` with the columns of the event log
EV = (
    RAW
    + f""",
gaps AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('microsecond', lag(ts) OVER w, ts) > 43200000000
                 THEN 1 ELSE 0 END AS opens
  FROM raw WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
sess AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM gaps
),
typed AS (
  SELECT *, event_type AS raw_type, {_TYPE} AS kind,
         CASE WHEN event_type = 'view' THEN 'system' ELSE {pick('k', _ACTORS)} END AS actor_type
  FROM sess
),
ev AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
         user_id || '-' || session_no AS case_id,
         'EXT-' || user_id || '-' || k AS external_event_id,
         kind AS event_type, ts AS event_at,
         ts + to_minutes(CAST(floor(value * 60) AS BIGINT)) AS ingested_at,
         actor_type,
         CASE WHEN actor_type IN {_INTERNAL} THEN 'STAFF-' || ((user_id + k % 3) % 5) END AS actor_id,
         {pick('k', vocab.SOURCE_SYSTEMS[:5])} AS source_system,
         {pick('k', vocab.CHANNELS)} AS channel,
         (k % 2 = 0) AS manual,
         CASE WHEN k % 3 <> 0 THEN {pick('k', vocab.REASON_CODES)} END AS reason_code,
         props AS metadata,
         CASE WHEN kind IN ('clinical_team_assigned', 'clinical_team_reassigned') THEN 'TEAM-' || (k % 4) END AS team_id,
         CASE WHEN k = 99 THEN 2 ELSE 1 END AS schema_version,
         user_id, session_no, value, k
  FROM typed
)"""
)

CASES = (
    EV
    + f""",
ends AS (
  SELECT case_id, user_id, session_no, min(event_at) AS received_at, max(event_at) AS last_at,
         min_by(event_at, (event_at, event_id)) FILTER (WHERE event_type IN {_TERMINAL}) AS end_at,
         min_by(event_type, (event_at, event_id)) FILTER (WHERE event_type IN {_TERMINAL}) AS end_type
  FROM ev WHERE user_id % 40 <> 39 GROUP BY ALL
),
cases AS (
  SELECT case_id, 'CASE-' || upper(replace(case_id, '-', 'S')) AS external_source_id,
         {pick('user_id', vocab.REFERRAL_SOURCES)} AS referral_source,
         {pick('user_id', vocab.SERVICE_LINES)} AS service_line,
         CASE WHEN end_type IS NOT NULL THEN replace(end_type, 'referral_', '')
              ELSE {pick('user_id', vocab.OPEN_STATUSES)} END AS status,
         received_at, CASE WHEN user_id % 11 <> 0 THEN end_at END AS closed_at,
         CASE WHEN user_id % 50 = 49 THEN 2 ELSE 1 END AS schema_version,
         received_at AS created_at,
         CASE WHEN user_id % 13 = 0 THEN received_at - INTERVAL 1 HOUR ELSE last_at END AS updated_at
  FROM ends
)"""
)

# canonical timelines: known cases, first copy of each source identity, positions
TL = (
    CASES
    + """,
copies AS (
  SELECT ev.*, row_number() OVER (PARTITION BY case_id, source_system, external_event_id
                                  ORDER BY event_at, event_id) AS copy_no
  FROM ev WHERE case_id IN (SELECT case_id FROM cases)
),
tl AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(event_at) OVER w AS prev_at,
         lag(ingested_at) OVER w AS prev_ingested, lead(event_at) OVER w AS next_at
  FROM copies WHERE copy_no = 1
  WINDOW w AS (PARTITION BY case_id ORDER BY event_at, event_id)
)"""
)

_IS = {
    "received": "referral_received",
    "check": "completeness_check_completed",
    "request": "missing_information_requested",
    "response": "missing_information_received",
    "cat": "referral_categorised",
    "recat": "referral_recategorised",
    "assigned": "clinical_team_assigned",
    "reassigned": "clinical_team_reassigned",
    "start": "appointment_scheduling_started",
    "failed": "appointment_scheduling_failed",
    "booked": "appointment_booked",
}


def at(kind: str, what: str = "event_at") -> str:
    return f"min_by({what}, pos) FILTER (WHERE event_type = '{_IS[kind]}')"


def n(kind: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{_IS[kind]}')"


CUTOFF = "TIMESTAMP '2024-02-15 00:00:00'"

# answered requests by walking each case with a queue of open requests
FIFO = (
    "RECURSIVE "
    + TL
    + f""",
walk(case_id, pos, pend, s, e, req_at) AS (
  SELECT case_id, CAST(-1 AS BIGINT), CAST([] AS TIMESTAMP[]), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP),
         CAST(NULL AS TIMESTAMP)
  FROM (SELECT DISTINCT case_id FROM tl)
  UNION ALL
  SELECT t.case_id, t.pos,
         CASE WHEN t.event_type = '{_IS['request']}' THEN list_append(w.pend, t.event_at)
              WHEN t.event_type = '{_IS['response']}' AND len(w.pend) > 0 THEN w.pend[2:]
              ELSE w.pend END,
         CASE WHEN t.event_type = '{_IS['response']}' AND len(w.pend) > 0 THEN w.pend[1] END,
         CASE WHEN t.event_type = '{_IS['response']}' AND len(w.pend) > 0 THEN t.event_at END,
         CASE WHEN t.event_type = '{_IS['request']}' THEN t.event_at END
  FROM walk w JOIN tl t ON t.case_id = w.case_id AND t.pos = w.pos + 1
),
paired AS (SELECT case_id, s, e FROM walk WHERE s IS NOT NULL),
unpaired AS (
  SELECT case_id, unnest(pend) AS s FROM (SELECT case_id, max_by(pend, pos) AS pend FROM walk GROUP BY 1)
)"""
)

# all waits, merged, in working hours
WAITS = (
    FIFO
    + f""",
firsts AS (
  SELECT case_id, {at('received', 'pos')} AS r_pos, {at('received')} AS r_at, {at('check', 'pos')} AS c_pos,
         {at('check')} AS c_at, {at('start', 'pos')} AS st_pos, {at('start')} AS st_at,
         count(*) FILTER (WHERE event_type IN {_TERMINAL}) AS n_end
  FROM tl GROUP BY 1
),
waits AS (
  SELECT case_id, r_at AS s, c_at AS e FROM firsts WHERE r_pos < c_pos
  UNION ALL SELECT case_id, s, e FROM paired
  UNION ALL SELECT case_id, s, NULL FROM unpaired
  UNION ALL
  SELECT t.case_id, max(t.event_at), any_value(f.st_at) FROM tl t JOIN firsts f USING (case_id)
  WHERE t.event_type IN ('{_IS['assigned']}', '{_IS['reassigned']}') AND t.pos < f.st_pos GROUP BY 1
  UNION ALL
  SELECT t.case_id, t.event_at, (SELECT min_by(x.event_at, x.pos) FROM tl x WHERE x.case_id = t.case_id
                                 AND x.pos > t.pos AND x.event_type = '{_IS['start']}')
  FROM tl t WHERE t.event_type = '{_IS['failed']}'
),
resolved AS (
  SELECT w.case_id, s, coalesce(e, {CUTOFF}) AS e, e IS NULL AS open_end,
         e IS NULL AND NOT (n_end = 0 AND s <= {CUTOFF}) AS lost
  FROM waits w JOIN firsts USING (case_id)
),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY case_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY case_id ORDER BY s, e
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
    FROM resolved WHERE NOT lost)
),
merged AS (SELECT case_id, island, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2),
waiting AS (
  SELECT c.case_id, coalesce(m.wait, 0.0) AS wait, coalesce(r.part, false) AS part, coalesce(r.lost, 0) AS lost
  FROM cases c
  LEFT JOIN (SELECT case_id, sum({business('s', 'e')}) AS wait FROM merged GROUP BY 1) m USING (case_id)
  LEFT JOIN (SELECT case_id, bool_or(open_end AND NOT lost) AS part, count(*) FILTER (WHERE lost) AS lost
             FROM resolved GROUP BY 1) r USING (case_id)
)"""
)

# one row per analysed case with every metric
CM = (
    WAITS
    + f""",
acts AS (
  SELECT case_id, count(*) FILTER (WHERE prev_actor IS NOT NULL AND prev_actor <> actor_id) AS handoffs FROM (
    SELECT case_id, actor_id, lag(actor_id) OVER (PARTITION BY case_id ORDER BY pos) AS prev_actor
    FROM tl WHERE actor_type IN {_INTERNAL} AND actor_id IS NOT NULL) GROUP BY 1
),
ing AS (
  SELECT case_id, count(*) AS n_events, {at('received', 'pos')} AS r_pos, {at('received')} AS r_at,
    min_by(event_at, pos) FILTER (WHERE event_type IN {_TERMINAL}) AS e_at,
    count(*) FILTER (WHERE event_type IN {_TERMINAL}) AS n_end,
    {at('check')} AS c_at, {at('check', 'pos')} AS c_pos, {at('cat', 'pos')} AS cat_pos,
    {at('assigned')} AS a_at, {at('assigned', 'pos')} AS a_pos, {at('booked')} AS b_at,
    max_by(event_at, pos) FILTER (WHERE event_type IN {quoted(vocab.PROGRESS_EVENTS)}) AS p_at,
    count(*) FILTER (WHERE manual) AS manual, {n('check')} AS checks, {n('request')} AS requests,
    {n('recat')} AS recats, {n('reassigned')} AS reassigned, {n('failed')} AS failed,
    {n('cat')} + {n('recat')} AS cats,
    max({hours('event_at', 'ingested_at')}) AS max_delay,
    count(*) FILTER (WHERE {hours('event_at', 'ingested_at')} > 24) AS delayed,
    coalesce(bool_or(ingested_at < prev_ingested), false) AS disorder,
    coalesce(bool_or(event_at = prev_at), false) AS same_time,
    bool_or(schema_version <> 1) AS bad_version,
    {at('received', 'source_system')} AS source_system,
    max_by(team_id, pos) FILTER (WHERE team_id IS NOT NULL) AS assigned_team
  FROM tl GROUP BY 1
),
late AS (
  SELECT i.case_id, count(*) FILTER (WHERE t.event_type = '{_IS['request']}' AND t.pos > i.c_pos
                                     AND t.pos < coalesce(i.cat_pos, 1000000)) AS late_requests,
         max_by(t.event_at, t.pos) FILTER (WHERE t.event_type IN ('{_IS['cat']}', '{_IS['recat']}')
                                           AND t.pos < i.a_pos) AS cat_at
  FROM ing i JOIN tl t USING (case_id) GROUP BY 1
),
cm AS (
  SELECT c.case_id, c.status AS terminal_outcome, c.referral_source, c.service_line, i.source_system,
    i.assigned_team, c.received_at, c.closed_at, i.n_events AS events, w.lost AS unmatched_waits,
    i.n_end AS terminals, i.checks, i.r_at IS NOT NULL AS has_received, i.same_time AS identical_timestamps,
    CASE WHEN r_at IS NULL OR e_at < r_at THEN NULL WHEN e_at IS NOT NULL THEN {hours('r_at', 'e_at')}
         WHEN {CUTOFF} >= r_at THEN {hours('r_at', CUTOFF)} END AS case_duration_hours,
    CASE WHEN r_at IS NULL THEN 'unavailable' WHEN e_at < r_at THEN 'invalid_input'
         WHEN e_at IS NOT NULL THEN 'calculated' WHEN {CUTOFF} >= r_at THEN 'partial'
         ELSE 'excluded' END AS case_duration_hours_status,
    CASE WHEN e_at >= r_at THEN {hours('r_at', 'e_at')} END AS cycle_time_hours,
    CASE WHEN r_at IS NULL THEN 'unavailable' WHEN e_at < r_at THEN 'invalid_input'
         WHEN e_at IS NOT NULL THEN 'calculated' ELSE 'not_applicable' END AS cycle_time_hours_status,
    manual AS manual_touches, 'calculated' AS manual_touches_status,
    manual * 10.0 / 60 AS processing_time_estimate_hours, 'estimated' AS processing_time_estimate_hours_status,
    coalesce(handoffs, 0) AS handoffs, 'estimated' AS handoffs_status,
    greatest(checks - 1, 0) + greatest(requests - 1, 0) + recats + reassigned + failed AS rework_count,
    CASE WHEN greatest(checks - 1, 0) + greatest(requests - 1, 0) > 0 THEN 'estimated' ELSE 'calculated' END
      AS rework_count_status,
    failed AS failed_scheduling_attempts, 'calculated' AS failed_scheduling_attempts_status,
    reassigned AS reassignment_count, 'calculated' AS reassignment_count_status,
    CASE WHEN e_at IS NOT NULL THEN false WHEN p_at <= {CUTOFF} THEN {hours('p_at', CUTOFF)} >= 120 END AS is_stuck,
    CASE WHEN e_at IS NOT NULL OR p_at <= {CUTOFF} THEN 'calculated' ELSE 'unavailable' END AS is_stuck_status,
    CASE WHEN c_at IS NOT NULL AND (cat_pos IS NOT NULL OR late_requests > 0) THEN late_requests = 0 END
      AS first_pass_complete,
    CASE WHEN c_at IS NOT NULL AND (cat_pos IS NOT NULL OR late_requests > 0) THEN 'estimated'
         ELSE 'unavailable' END AS first_pass_complete_status,
    CASE WHEN c_at >= r_at THEN {hours('r_at', 'c_at')} END AS time_to_first_completeness_check_hours,
    CASE WHEN c_at >= r_at THEN 'calculated' WHEN c_at < r_at THEN 'invalid_input' ELSE 'unavailable' END
      AS time_to_first_completeness_check_hours_status,
    CASE WHEN b_at >= r_at THEN {hours('r_at', 'b_at')} END AS time_to_appointment_booking_hours,
    CASE WHEN b_at >= r_at THEN 'calculated' WHEN b_at < r_at THEN 'invalid_input'
         WHEN c.status IN {quoted(vocab.TERMINAL_STATUSES)} THEN 'not_applicable' ELSE 'unavailable' END
      AS time_to_appointment_booking_hours_status,
    w.wait AS waiting_time_business_hours,
    CASE WHEN w.part THEN 'partial' ELSE 'estimated' END AS waiting_time_business_hours_status,
    CASE WHEN a_at IS NOT NULL AND cat_at IS NOT NULL THEN {business('cat_at', 'a_at')} END
      AS assignment_wait_business_hours,
    CASE WHEN a_at IS NULL OR cats = 0 THEN 'unavailable' WHEN cat_at IS NOT NULL THEN 'estimated'
         ELSE 'invalid_input' END AS assignment_wait_business_hours_status,
    max_delay AS max_ingestion_delay_hours, 'calculated' AS max_ingestion_delay_hours_status,
    delayed AS delayed_event_count, 'calculated' AS delayed_event_count_status,
    disorder AS out_of_order_ingestion, 'calculated' AS out_of_order_ingestion_status
  FROM cases c JOIN ing i USING (case_id) JOIN late USING (case_id) JOIN waiting w USING (case_id)
  LEFT JOIN acts USING (case_id)
  WHERE c.schema_version = 1 AND NOT i.bad_version
)"""
)

_LABELS = "CASE event_type " + " ".join(
    f"WHEN '{e}' THEN '{a}'" for e, a in vocab.ACTIVITY_LABELS.items()
) + " END"

# process log: supported cases, activity labels, neighbours
PL_FROM_TL = f""",
pl AS (
  SELECT t.case_id, t.event_id, t.event_at, t.manual, t.actor_type, coalesce(t.team_id, t.actor_id) AS owner,
         c.status, c.referral_source, c.service_line, {_LABELS} AS activity, t.pos,
         lead({_LABELS}) OVER w AS next_activity, lead(event_at) OVER w AS next_at,
         lead(manual) OVER w AS next_manual, lead(actor_type) OVER w AS next_actor_type,
         lead(coalesce(team_id, actor_id)) OVER w AS next_owner
  FROM tl t JOIN cases c USING (case_id)
  WHERE c.schema_version = 1
    AND case_id NOT IN (SELECT case_id FROM tl WHERE schema_version <> 1)
  WINDOW w AS (PARTITION BY t.case_id ORDER BY t.pos)
),
edges AS (
  SELECT *, activity AS source, next_activity AS target, {hours('event_at', 'next_at')} AS hours
  FROM pl WHERE next_activity IS NOT NULL
)"""
PL = TL + PL_FROM_TL

VARIANTS_FROM_PL = """,
seqs AS (
  SELECT case_id, list(activity ORDER BY pos) AS acts, count(*) AS length FROM pl GROUP BY 1
),
cv AS (
  SELECT case_id, length, acts, 'variant-' || sha256('{"activities":["' || array_to_string(acts, '","') ||
         '"],"activity_mapping_version":"activity-map-v1"}') AS variant_id FROM seqs
),
cores AS (
  SELECT variant_id, count(*) AS cases, min(case_id) AS representative, max(length) AS length,
         any_value(acts) AS acts,
         CASE WHEN count(*) <= 2 THEN 'rare' WHEN count(*) >= 2 THEN 'common' ELSE 'uncommon' END AS class
  FROM cv GROUP BY 1
)"""
VAR = PL + VARIANTS_FROM_PL


def with_(base: str, body: str) -> str:
    return f"WITH {base.strip()}\n{body}"
