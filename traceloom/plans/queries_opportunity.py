"""Registered queries: evidence, opportunities and their ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import cohorts, conformance, mining, variants
from ..operators import opportunities as op
from ..sources.files import research_problems
from ..sources.snapshots import research_observations
from ..session import pin
from ..spec import OpportunitySpec
from . import queries_mining as m
from . import sql as q
from .registry import joined, query, tidy
from .sql import with_
from .workspace import Portfolio, Workspace

_ARCH = tuple(op.ARCHETYPES)

OBS = f"""
obs AS (
  SELECT 'SESSION-' || conv_id AS session_id, 'OBS-' || conv_id || '-' || turn AS observation_id, role,
    CASE WHEN turn % 3 = 1 THEN 'service_line' END AS o_dim,
    CASE WHEN turn % 3 = 1 THEN {q.pick('conv_id', vocab.SERVICE_LINES)} END AS o_val,
    'problem-' || (length(text) % 7) AS problem, {q.pick('turn', ('low', 'moderate', 'high'))} AS severity,
    {q.pick('conv_id + turn', _ARCH)} AS archetype,
    CASE WHEN turn > 1 AND turn % 4 = 2 THEN 'OBS-' || conv_id || '-' || (turn - 1) END AS other
  FROM conversations WHERE role <> 'system'
),
clash AS (
  SELECT DISTINCT least(observation_id, other) AS left_id, greatest(observation_id, other) AS right_id FROM obs WHERE other IS NOT NULL
)"""


def _row(source: str, record: str, metric: str, fact: str, dim: str, val: str, observed: str, sample: str,
         materiality: str, confidence: str, warnings: str, rest: str) -> str:
    return (
        f"SELECT '{source}' AS source_type, {record} AS record_id, {metric} AS metric, {fact} AS fact, {dim} AS dimension, "
        f"{val} AS value, CAST({observed} AS DOUBLE) AS observed, CAST({sample} AS BIGINT) AS sample_size, "
        f"{materiality} AS materiality, {confidence} AS confidence, {warnings} AS warnings FROM {rest}"
    )


_N = "CAST(NULL AS VARCHAR)"
EVIDENCE = (
    m.FINDINGS
    + q.PL_FROM_TL
    + q.VARIANTS_FROM_PL
    + m.TRANSITIONS_FROM_PL
    + m.FEATURES_FROM_PL
    + m.STRICT_DEV[len(q.VAR):]
    + m.GOV_DEV_ALL
    + m.VARIANT_TABLE[m.VARIANT_TABLE.index(",\nvt AS (") :]
    + """,
del AS (SELECT * FROM edges WHERE source IN ('Referral categorised', 'Referral recategorised') AND target = 'Clinical team assigned'),
cand0 AS (
  SELECT candidate_type, subject, dimension, value, cases, frequency, comparison, observed, median_hours FROM frate
  WHERE cases >= 20 AND comparison > 0 AND (observed - comparison) / comparison >= 0.2
  UNION ALL SELECT 'service_line_assignment_delay', 'Referral categorised -> Clinical team assigned', 'service_line', service_line,
    any_value(n), count(*), (SELECT median(hours) FROM del), median(hours), median(hours)
  FROM del JOIN (SELECT service_line, count(DISTINCT case_id) AS n FROM pl GROUP BY 1) USING (service_line) GROUP BY service_line
  HAVING any_value(n) >= 20 AND median(hours) >= 1.2 * (SELECT median(hours) FROM del)
  UNION ALL SELECT 'high_frequency_slow_transition', source || ' -> ' || target, NULL, NULL, cases, frequency, b, hours_median, hours_median
  FROM ts, (SELECT median(hours_median) AS b FROM ts WHERE frequency >= 5) WHERE frequency >= 5 AND hours_median >= b * 1.5
  UNION ALL SELECT 'variant_elevated_duration', variant_id, NULL, NULL, cases, cases, b, duration_median, duration_median
  FROM vt, (SELECT median(duration_median) AS b FROM vt) WHERE cases >= 2 AND duration_median >= b * 1.5
  UNION ALL SELECT 'nonconforming_path_duration', 'governed non-conforming traces', NULL, NULL, count(*), count(*), NULL, NULL, median(elapsed)
  FROM feat JOIN cv USING (case_id) JOIN vfit USING (variant_id)
  WHERE fitness < 1 OR variant_id IN (SELECT variant_id FROM gdev WHERE category <> 'scheduling_retry') HAVING count(*) >= 20
),
cand AS (SELECT 'candidate-' || substr(sha256(candidate_type || chr(31) || subject || chr(31) || coalesce(value, '')), 1, 16) AS candidate_id, * FROM cand0),
logq AS (
  SELECT (SELECT count(*) FROM copies WHERE copy_no > 1) AS duplicates, count(*) FILTER (WHERE disorder) AS disorder,
    count(*) FILTER (WHERE ok AND events > 0) AS analysed
  FROM (SELECT c.case_id, count(t.event_id) AS events, coalesce(bool_or(t.ingested_at < t.prev_ingested), false) AS disorder,
      any_value(c.schema_version) = 1 AND NOT coalesce(bool_or(t.schema_version <> 1), false) AS ok
    FROM cases c LEFT JOIN tl t USING (case_id) GROUP BY 1)
),
marked AS (SELECT variant_id, cases, class, array_to_string("""
    + m._MARKER_SQL
    + """, ',') AS markers FROM cores),
gsum AS (SELECT category, CAST(sum(cases) AS BIGINT) AS deviations FROM gdev JOIN cores USING (variant_id) GROUP BY 1),
late AS (SELECT count(*) AS analysed, count(*) FILTER (WHERE delayed_event_count > 0) AS delayed,
  count(*) FILTER (WHERE out_of_order_ingestion) AS disorder FROM cm),"""
    # `late` and `base` names of the metric statement stay apart from these
    + OBS
).replace("\nlate AS (SELECT count(*) AS analysed", "\nlateness AS (SELECT count(*) AS analysed")

EVIDENCE += (
    ",\ne0 AS (\n"
    + "\nUNION ALL ".join(
        [
            _row("baseline_finding", "finding_id", "metric", "metric", "dimension", "value", "observed", "cases",
                 "materiality", "'high'", "2", "found"),
            _row("cohort_metric", "dimension || ':' || value", "metric", "metric", "dimension", "value", "observed", "sample",
                 _N, "CASE WHEN observed IS NULL THEN 'low' ELSE 'high' END", "CASE WHEN observed IS NULL THEN 1 ELSE 0 END", "vals"),
            _row("baseline_quality", "'quality'", "'delayed_ingestion_cases'", "'delayed_ingestion_cases'", _N, _N, "delayed",
                 "analysed", _N, "'high'", "0", "lateness"),
            _row("baseline_quality", "'quality'", "'out_of_order_ingestion_cases'", "'out_of_order_ingestion_cases'", _N, _N,
                 "disorder", "analysed", _N, "'high'", "0", "lateness"),
            _row("process_candidate", "candidate_id", "candidate_type", "candidate_type", "dimension", "value", "frequency", "cases",
                 "CASE WHEN (observed - comparison) / comparison >= 0.5 THEN 'strong' WHEN (observed - comparison) / comparison >= 0.2 "
                 "THEN 'material' ELSE 'small' END", "'high'", "1", "cand"),
            _row("process_quality", "'quality'", "'duplicate_events_excluded'", "'duplicate_events_excluded'", _N, _N, "duplicates",
                 "analysed", _N, "'high'", "0", "logq"),
            _row("process_quality", "'quality'", "'out_of_order_ingestion_cases'", "'out_of_order_ingestion_cases'", _N, _N, "disorder",
                 "analysed", _N, "'high'", "0", "logq"),
            _row("process_transition", "transition_id", "source || ' -> ' || target", "'median_elapsed_hours'", _N, _N,
                 "hours_median", "cases", _N, "'high'", "0", "ts"),
            _row("process_variant", "variant_id", "markers", "'markers'", _N, _N, "cases", "cases", "class", "'high'", "0",
                 "marked WHERE markers <> ''"),
            _row("process_deviation", "category", "category", "'count'", _N, _N, "deviations", "(SELECT count(*) FROM cv)", _N,
                 "'moderate'", "1", "gsum"),
            _row("research_observation", "observation_id", "problem", "problem", "o_dim", "o_val", "NULL", "1", "severity",
                 "'moderate'", "1", "obs"),
        ]
    )
    + """
),
e AS (SELECT 'evidence-' || substr(sha256(source_type || chr(31) || record_id || chr(31) || fact), 1, 16) AS evidence_id, * FROM e0),
"""
)
_RULES = ", ".join(
    f"('{r}', '{a}', '{d}', '{s}', {q._list(f)}, {q._list(t)})" for r, a, d, s, f, t in op.PATTERN_RULES
)
_PROFILES = ", ".join(
    "(" + ", ".join(
        "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in (a, *p)
    ) + ")"
    for a, p in op.ARCHETYPES.items()
)
_STUCK, _LATE = op.VOLUME_RULES
SEEDS = (
    EVIDENCE
    + f"""prules(rule_id, archetype, dimension, stage, finding_types, terms) AS (VALUES {_RULES}),
profile(archetype, stable_rules, integration, risk, risk_level, prototype, stable, candidate_type, counts_rework) AS (VALUES {_PROFILES}),
volume AS (
  SELECT '{_STUCK[0]}' AS rule_id, deviations AS volume FROM gsum WHERE category = 'missing_terminal_event'
  UNION ALL SELECT '{_LATE[0]}', greatest(delayed, disorder) FROM lateness
),
hit AS (
  SELECT r.rule_id || '|' || f.finding_id AS target_id, r.rule_id, r.archetype, r.dimension, f.value, r.stage, r.terms, f.metric
  FROM found f JOIN prules r ON r.dimension = f.dimension AND list_contains(r.finding_types, f.finding_type) WHERE f.cases >= 20
),
lp AS (
  SELECT DISTINCT h.target_id, e.evidence_id FROM hit h JOIN e
    ON e.source_type IN {q.quoted(op.PROCESS_SOURCES)}
    AND (e.dimension IS NULL OR (e.dimension = h.dimension AND e.value = h.value))
    AND len(list_filter(h.terms, lambda t: contains(e.metric, t))) > 0
),
lm AS (
  SELECT DISTINCT h.target_id, e.evidence_id FROM hit h JOIN e
    ON e.source_type IN ('baseline_finding', 'cohort_metric') AND e.dimension = h.dimension AND e.value = h.value
    AND contains(e.metric, h.metric)
),
lv AS (
  SELECT v.rule_id AS target_id, e.evidence_id FROM volume v JOIN e ON v.volume >= 20 AND (
    (v.rule_id = '{_STUCK[0]}' AND e.source_type IN {q.quoted(_STUCK[5])}
      AND (e.dimension IS NULL OR (e.dimension = 'overall' AND e.value = 'all'))
      AND ({' OR '.join(f"contains(e.metric, '{t}')" for t in _STUCK[6])}))
    OR (v.rule_id = '{_LATE[0]}' AND e.source_type IN {q.quoted(_LATE[5])} AND e.dimension IS NULL
      AND ({' OR '.join(f"contains(e.metric, '{t}')" for t in _LATE[6])})))
),
seed AS (
  SELECT target_id, rule_id, archetype, dimension, value, stage FROM hit WHERE target_id IN (SELECT target_id FROM lp)
  UNION ALL SELECT rule_id, rule_id, '{_STUCK[1]}', '{_STUCK[2]}', '{_STUCK[3]}', '{_STUCK[4]}' FROM volume WHERE volume >= 20 AND rule_id = '{_STUCK[0]}'
  UNION ALL SELECT rule_id, rule_id, '{_LATE[1]}', '{_LATE[2]}', '{_LATE[3]}', '{_LATE[4]}' FROM volume WHERE volume >= 20 AND rule_id = '{_LATE[0]}'
),
opp AS (
  SELECT 'opportunity-' || substr(sha256(archetype || chr(31) || dimension || chr(31) || value || chr(31) || stage || chr(31)
    || 'opportunity-rules-v1'), 1, 16) AS opportunity_id, archetype, dimension, value, stage,
    string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, count(*) AS merged, list(target_id) AS targets
  FROM seed GROUP BY archetype, dimension, value, stage
),
ln AS (
  SELECT DISTINCT opportunity_id, 'supports' AS kind, evidence_id FROM opp JOIN
    (SELECT * FROM lp UNION SELECT * FROM lm UNION SELECT * FROM lv) l ON list_contains(targets, l.target_id)
  UNION ALL
  SELECT DISTINCT opportunity_id, 'qualifies', e.evidence_id FROM opp p JOIN obs o ON o.archetype = p.archetype
    AND (o.o_dim IS NULL OR (o.o_dim = p.dimension AND o.o_val = p.value))
    JOIN e ON e.source_type = 'research_observation' AND e.record_id = o.observation_id
)"""
)
BURDEN = (
    SEEDS
    + """,
ctouch AS (
  SELECT dimension, value, max(cases) AS cohort_cases, max(mean) FILTER (WHERE metric = 'manual_touches') AS touches,
    max(mean) FILTER (WHERE metric = 'handoffs') AS handoff_mean FROM sums GROUP BY 1, 2
),
bur AS (
  SELECT p.*, f.* EXCLUDE (archetype), coalesce(c.cohort_cases, o.cohort_cases) AS cohort_cases,
    coalesce(c.touches, o.touches) AS touches, coalesce(c.handoff_mean, o.handoff_mean) AS handoff_mean,
    k.frequency AS c_freq, k.median_hours AS delay_hours,
    CASE WHEN f.candidate_type IS NULL THEN v.volume ELSE least(k.frequency, k.cases) END AS affected
  FROM opp p JOIN profile f USING (archetype) LEFT JOIN ctouch c ON c.dimension = p.dimension AND c.value = p.value
  CROSS JOIN (SELECT * FROM ctouch WHERE dimension = 'overall') o
  LEFT JOIN cand k ON k.candidate_type = f.candidate_type AND k.dimension = p.dimension AND k.value = p.value
  LEFT JOIN volume v ON v.rule_id = p.rule_ids
),
inp AS (
  SELECT p.opportunity_id, count(*) FILTER (WHERE kind = 'supports') AS quantitative,
    count(DISTINCT source_type) FILTER (WHERE kind = 'supports') AS source_types,
    coalesce(max(sample_size) FILTER (WHERE kind = 'supports'), 0) AS max_sample,
    count(*) FILTER (WHERE kind = 'supports' AND warnings > 0) AS warned,
    count(*) FILTER (WHERE kind = 'qualifies') AS qualitative,
    coalesce(max(CASE materiality WHEN 'low' THEN 35.0 WHEN 'moderate' THEN 65.0 WHEN 'high' THEN 90.0 ELSE 50.0 END)
      FILTER (WHERE kind = 'qualifies'), 0) AS pain,
    (SELECT count(DISTINCT (left_id, right_id)) FROM clash JOIN obs x ON x.observation_id IN (left_id, right_id)
      WHERE x.archetype = p.archetype AND (x.o_dim IS NULL OR (x.o_dim = p.dimension AND x.o_val = p.value))) AS contradictions
  FROM opp p LEFT JOIN ln USING (opportunity_id) LEFT JOIN e USING (evidence_id)
  GROUP BY p.opportunity_id, p.archetype, p.dimension, p.value
),
scored AS (
  SELECT b.*, i.* EXCLUDE (opportunity_id),
    (least(100.0, coalesce(affected, 0) / 5) + least(100.0, coalesce(touches * affected, 0) / 20)
     + least(100.0, CASE WHEN counts_rework THEN coalesce(c_freq, 0) ELSE 0 END / 3) + least(100.0, coalesce(delay_hours, 0) / 2)
     + pain + least(100.0, source_types * 20.0)) / 6 AS value_score,
    least(100.0, greatest(0.0, 35.0 + least(30.0, source_types * 10.0) + CASE WHEN max_sample >= 100 THEN 15.0 ELSE 5.0 END
     + least(15.0, qualitative * 5.0) - contradictions * 12.0 - least(15.0, warned * 2.0))) AS confidence_score,
    (435.0 + stable_rules + integration + CASE WHEN qualitative > 0 THEN 85.0 ELSE 60.0 END) / 8 AS readiness_score
  FROM bur b JOIN inp i USING (opportunity_id)
),
prio AS (
  SELECT *, CASE WHEN quantitative < 2 THEN 'needs_more_evidence' WHEN prototype THEN 'eligible_for_controlled_prototype'
    ELSE 'eligible_for_further_discovery' END AS eligibility,
    0.40 * value_score + 0.25 * readiness_score + 0.25 * confidence_score - 0.10 * risk AS priority FROM scored
),
ranked AS (
  SELECT *, CASE WHEN eligibility = 'eligible_for_controlled_prototype' AND priority >= 55 THEN 'controlled_prototype'
    ELSE 'further_discovery' END AS section FROM prio
)"""
)


_PORTFOLIOS: dict[tuple, Portfolio] = {}


def portfolio(spark, folder) -> Portfolio:
    """The stored stage tables of a folder, built once per application and shared."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PORTFOLIOS:
        ws = Workspace.of_sessions(spark, folder, store=True)
        told = pin(research_observations(spark, folder, _ARCH))
        _PORTFOLIOS[key] = Portfolio(ws, told, OpportunitySpec())
    return _PORTFOLIOS[key]


@query(
    "union_evidence",
    with_(
        EVIDENCE.rstrip().rstrip(","),
        "SELECT evidence_id, source_type, record_id, metric, dimension, value, round(observed, 6) AS observed, sample_size, "
        "materiality, confidence FROM e",
    ),
)
def union_evidence(spark, folder):
    return tidy(
        portfolio(spark, folder).evidence.select(
            "evidence_id", "source_type", "record_id", "metric", "dimension", "value", "observed", "sample_size",
            "materiality", "confidence",
        )
    )


@query(
    "evidence_registry",
    with_(EVIDENCE.rstrip().rstrip(","), "SELECT CAST(count(*) AS BIGINT) AS repeated_ids FROM (SELECT evidence_id FROM e GROUP BY 1 HAVING count(*) > 1)"),
)
def evidence_registry(spark, folder):
    return op.repeated_evidence(portfolio(spark, folder).evidence).agg(F.count(F.lit(1)).alias("repeated_ids"))


@query(
    "evidence_quality",
    with_(
        EVIDENCE.rstrip().rstrip(","),
        "SELECT source_type, confidence, count(*) AS records, CAST(sum(warnings) AS BIGINT) AS warnings FROM e GROUP BY 1, 2",
    ),
)
def evidence_quality(spark, folder):
    return op.evidence_quality(portfolio(spark, folder).evidence)


@query(
    "graph_edges",
    with_(
        EVIDENCE.rstrip().rstrip(","),
        """SELECT t.transition_id AS edge_id, 'activity-' || substr(sha256(t.source), 1, 12) AS source_node,
  'activity-' || substr(sha256(t.target), 1, 12) AS target_node, t.frequency, t.cases, round(hours_median, 6) AS hours_median,
  round(hours_p75, 6) AS hours_p75, round(hours_p90, 6) AS hours_p90, round(hours_p95, 6) AS hours_p95, round(work_median, 6) AS work_median,
  round(handoff_rate, 6) AS handoff_rate, round(rework_rate, 6) AS rework_rate, round(coalesce(d.n, 0) / t.cases, 6) AS deviation_rate, bottleneck
FROM ts t
LEFT JOIN (SELECT source, target, count(DISTINCT case_id) AS n FROM edges JOIN cv USING (case_id)
  WHERE variant_id IN (SELECT variant_id FROM gdev) GROUP BY 1, 2) d ON d.source = t.source AND d.target = t.target
LEFT JOIN (SELECT subject, max_by(CASE WHEN (observed - comparison) / comparison >= 0.5 THEN 'strong' WHEN (observed - comparison) / comparison >= 0.2
    THEN 'material' ELSE 'small' END, candidate_id) AS bottleneck FROM cand WHERE contains(subject, ' -> ') GROUP BY 1) b
  ON b.subject = t.source || ' -> ' || t.target""",
    ),
)
def graph_edges(spark, folder):
    """Edges for display with the share of deviating cases and the bottleneck found on them."""
    ws = portfolio(spark, folder).ws
    bad = conformance.deviating_edges(variants.variant_paths(ws.steps, ws.scale), ws.cores, ws.governed_status)
    return tidy(mining.graph_edges(ws.transitions, ws.candidates, bad))


@query("distinct_pairs", f"WITH {OBS.strip()} SELECT left_id, right_id FROM clash")
def distinct_pairs(spark, folder):
    return op.contradiction_pairs(research_observations(spark, folder, _ARCH)).select("left_id", "right_id")


@query(
    "research_flatten_validate",
    f"""WITH {OBS.strip()}, spoilt AS (
  SELECT session_id, observation_id, role, CASE WHEN observation_id LIKE '%-1' AND session_id LIKE '%3' THEN 'someone' ELSE role END AS session_role,
    CASE WHEN session_id LIKE '%9' THEN 'P-shared' ELSE session_id END AS participant_id,
    CASE WHEN other IS NOT NULL AND session_id LIKE '%5' THEN other || 'x' ELSE other END AS other FROM obs
  UNION ALL SELECT session_id, observation_id, role, role, session_id, other FROM obs WHERE observation_id LIKE '%-2' AND session_id LIKE '%7')
SELECT problem, count(*) AS rows FROM (
  SELECT 'unknown_contradiction' AS problem FROM spoilt WHERE other IS NOT NULL AND other NOT IN (SELECT observation_id FROM spoilt)
  UNION ALL SELECT 'repeated_observation' FROM spoilt GROUP BY observation_id HAVING count(*) > 1
  UNION ALL SELECT 'role_differs' FROM spoilt WHERE role <> session_role
  UNION ALL SELECT 'repeated_participant' FROM spoilt GROUP BY participant_id HAVING count(DISTINCT session_id) > 1) GROUP BY 1""",
)
def research_flatten_validate(spark, folder):
    """A pack with every kind of fault in it: all are found."""
    told = research_observations(spark, folder, _ARCH)
    at = lambda observation, session: F.col("observation_id").endswith(observation) & F.col("session_id").endswith(session)
    again = told.where(at("-2", "7")).withColumn("participant_id", F.col("session_id"))
    unknown = F.transform("contradicts", lambda x: F.concat(x, F.lit("x")))
    spoilt = told.withColumns(
        {
            "session_role": F.when(at("-1", "3"), "someone").otherwise(F.col("session_role")),
            "participant_id": F.when(F.col("session_id").endswith("9"), "P-shared").otherwise(F.col("session_id")),
            "contradicts": F.when(F.col("session_id").endswith("5"), unknown).otherwise(F.col("contradicts")),
        }
    )
    got = research_problems(spoilt.unionByName(again))
    return got.groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))


# planted patterns as the process candidates that should show them
EXPECTED = (
    ("missing_information", "referral_source_rework_path", "referral_source", "gp_practice"),
    ("slow_assignment", "service_line_assignment_delay", "service_line", "neurology"),
    ("scheduling", "service_line_scheduling_retries", "service_line", "respiratory"),
    ("reassignment", "service_line_reassignment", "service_line", "dermatology"),
)


@query(
    "join_expected_candidates",
    with_(
        EVIDENCE
        + "expected(pattern, candidate_type, dimension, value) AS (VALUES "
        + ", ".join(str(x) for x in EXPECTED)
        + ")",
        """SELECT pattern, dimension, value, count(candidate_id) AS matches, coalesce(max(cases), 0) AS sample_size,
  CASE WHEN count(candidate_id) > 0 THEN 'detected' ELSE 'missed' END AS outcome
FROM expected LEFT JOIN cand USING (candidate_type, dimension, value) GROUP BY 1, 2, 3
UNION ALL SELECT '(extra)', dimension, value, count(*), max(cases), 'extra' FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM expected x WHERE x.candidate_type = c.candidate_type AND x.dimension = c.dimension AND x.value = c.value) GROUP BY 2, 3""",
    ),
)
def join_expected_candidates(spark, folder):
    found = portfolio(spark, folder).ws.candidates.select(
        F.col("candidate_type").alias("finding_type"), "dimension", "value", F.col("candidate_id").alias("finding_id"), F.col("cases").alias("cohort_cases")
    )
    rows = [(p, [kind], d, v) for p, kind, d, v in EXPECTED]
    return cohorts.expected_labels(found, spark.createDataFrame(rows, "pattern string, finding_types array<string>, dimension string, value string"))


@query("opportunity_seeds", with_(SEEDS, "SELECT target_id, rule_id, archetype, dimension, value, stage FROM seed"))
def opportunity_seeds(spark, folder):
    return portfolio(spark, folder).seeds.drop("opportunity_id")


@query(
    "join_cohort_or_wildcard",
    with_(SEEDS, "SELECT opportunity_id, kind, evidence_id FROM ln"),
)
def join_cohort_or_wildcard(spark, folder):
    return portfolio(spark, folder).links.select("opportunity_id", "kind", "evidence_id")


@query("dedup_seeds", with_(SEEDS, "SELECT opportunity_id, archetype, dimension, value, stage, rule_ids, merged FROM opp"))
def dedup_seeds(spark, folder):
    return portfolio(spark, folder).opportunities.withColumn("rule_ids", joined("rule_ids"))


@query(
    "observed_burden",
    with_(
        BURDEN,
        """SELECT opportunity_id, CAST(affected AS DOUBLE) AS affected, round(affected / cohort_cases, 6) AS affected_rate,
  round(touches * affected, 6) AS burden_touches, round(touches * affected * 5 / 60, 6) AS burden_hours,
  round(touches * affected * 5 / 60 * 24, 6) AS burden_cost, round(handoff_mean * affected, 6) AS burden_handoffs,
  CAST(CASE WHEN counts_rework THEN c_freq END AS DOUBLE) AS rework_events, round(delay_hours, 6) AS delay_hours FROM bur""",
    ),
)
def observed_burden(spark, folder):
    return tidy(
        portfolio(spark, folder).burden.select(
            "opportunity_id", "affected", "affected_rate", "burden_touches", "burden_hours", "burden_cost",
            "burden_handoffs", "rework_events", "delay_hours",
        )
    )


@query(
    "join_cohort_fallback",
    with_(BURDEN, "SELECT opportunity_id, cohort_cases, round(touches, 6) AS touches, round(handoff_mean, 6) AS handoff_mean FROM bur"),
)
def join_cohort_fallback(spark, folder):
    return tidy(portfolio(spark, folder).burden.select("opportunity_id", "cohort_cases", "touches", "handoff_mean"))


@query("value_score", with_(BURDEN, "SELECT opportunity_id, round(value_score, 6) AS value_score FROM ranked"))
def value_score(spark, folder):
    return tidy(portfolio(spark, folder).ranked.select("opportunity_id", "value_score"))


@query(
    "confidence_score",
    with_(
        BURDEN,
        "SELECT opportunity_id, quantitative, source_types, max_sample, warned, qualitative, contradictions, "
        "CAST(round(confidence_score, 6) AS DOUBLE) AS confidence_score FROM ranked",
    ),
)
def confidence_score(spark, folder):
    return tidy(
        portfolio(spark, folder).ranked.select(
            "opportunity_id", "quantitative", "source_types", "max_sample", "warned", "qualitative", "contradictions",
            "confidence_score",
        )
    )


@query(
    "readiness_risk_lookup",
    with_(BURDEN, "SELECT opportunity_id, round(readiness_score, 6) AS readiness_score, CAST(risk AS DOUBLE) AS risk, risk_level FROM ranked"),
)
def readiness_risk_lookup(spark, folder):
    return tidy(portfolio(spark, folder).ranked.select("opportunity_id", "readiness_score", "risk", "risk_level"))


@query(
    "eligibility_gates",
    with_(
        BURDEN,
        """SELECT opportunity_id, eligibility, section, g.gate AS gate, g.passed AS passed FROM (
  SELECT *, unnest([{'gate': 'administrative_scope', 'passed': true}, {'gate': 'evidence_sufficiency', 'passed': quantitative >= 2},
    {'gate': 'data_availability', 'passed': quantitative > 0}, {'gate': 'process_stability', 'passed': stable},
    {'gate': 'measurability', 'passed': true}, {'gate': 'reversibility', 'passed': true}, {'gate': 'human_oversight', 'passed': true},
    {'gate': 'auditability', 'passed': true}, {'gate': 'clinical_exclusion', 'passed': true}, {'gate': 'sensitive_data_exposure', 'passed': true}]) AS g
  FROM ranked)""",
    ),
)
def eligibility_gates(spark, folder):
    p = portfolio(spark, folder)
    return op.gate_rows(p.ranked, p.spec).select("opportunity_id", "eligibility", "section", "gate", "passed")


@query(
    "priority_rank",
    with_(
        BURDEN,
        """SELECT opportunity_id, round(priority, 6) AS priority, section,
  row_number() OVER (ORDER BY section <> 'controlled_prototype', priority DESC, opportunity_id)::INT AS position FROM ranked""",
    ),
)
def priority_rank(spark, folder):
    return tidy(portfolio(spark, folder).ranked.select("opportunity_id", "priority", "section", "position"))


# a threshold that some opportunities of these tables reach
REACHED = OpportunitySpec(prototype_threshold=40.0)


@query(
    "select_best",
    with_(
        BURDEN,
        f"""SELECT opportunity_id, archetype, value, round(priority, 6) AS priority FROM prio
WHERE eligibility = 'eligible_for_controlled_prototype' AND priority >= {REACHED.prototype_threshold}
ORDER BY risk, readiness_score DESC, confidence_score DESC, priority DESC, opportunity_id LIMIT 1""",
    ),
)
def select_best(spark, folder):
    p = portfolio(spark, folder)
    ranked = op.priority_rank(p.burden, p.inputs, REACHED)
    return tidy(op.select_best(ranked).select("opportunity_id", "archetype", "value", "priority"))


@query(
    "join_related_contradictions",
    with_(
        SEEDS,
        """SELECT DISTINCT p.opportunity_id, 'contradiction-' || substr(sha256(left_id || chr(31) || right_id), 1, 16) AS contradiction_id
FROM opp p JOIN obs o ON o.archetype = p.archetype AND (o.o_dim IS NULL OR (o.o_dim = p.dimension AND o.o_val = p.value))
JOIN clash ON o.observation_id IN (left_id, right_id)""",
    ),
)
def join_related_contradictions(spark, folder):
    p = portfolio(spark, folder)
    return op.related_contradictions(p.links, p.evidence, p.pairs)


@query(
    "evidence_network",
    with_(
        SEEDS,
        """, used AS (SELECT DISTINCT evidence_id FROM ln)
SELECT evidence_id AS source_id, opportunity_id AS target_id, kind AS relation FROM ln
UNION ALL SELECT a.evidence_id, b.evidence_id, 'contradicts' FROM clash JOIN e a ON a.record_id = left_id AND a.evidence_id IN (SELECT evidence_id FROM used)
  JOIN e b ON b.record_id = right_id AND b.evidence_id IN (SELECT evidence_id FROM used)""",
    ),
)
def evidence_network(spark, folder):
    p = portfolio(spark, folder)
    return op.evidence_network(p.opportunities, p.links, p.evidence, p.pairs)[1].select("source_id", "target_id", "relation")


@query(
    "evidence_network_nodes",
    with_(
        SEEDS,
        """SELECT opportunity_id AS node_id, 'opportunity' AS node_type, archetype || ': ' || value AS label FROM opp
UNION ALL SELECT evidence_id, source_type, metric FROM e WHERE evidence_id IN (SELECT evidence_id FROM ln)""",
    ),
)
def evidence_network_nodes(spark, folder):
    p = portfolio(spark, folder)
    return op.evidence_network(p.opportunities, p.links, p.evidence, p.pairs)[0].select("node_id", "node_type", "label")
