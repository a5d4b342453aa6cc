"""Evidence registry, opportunity seeds, burden, scores and ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..spec import OpportunitySpec

EVIDENCE = (
    "evidence_id",
    "source_type",
    "record_id",
    "metric",
    "dimension",
    "value",
    "observed",
    "sample_size",
    "direction",
    "materiality",
    "confidence",
    "warnings",
)
PROCESS_SOURCES = (
    "process_candidate",
    "process_transition",
    "process_variant",
    "process_deviation",
)

# --- fixed values: archetype profiles ----------------------------------------
# archetype: (stable rules, integration, risk, risk level, prototype allowed,
#             process stable, candidate type, counts rework)
ARCHETYPES = {
    "intake-completeness-validation": (
        75.0, 35.0, 40.0, "moderate", True, True, "referral_source_rework_path", True,
    ),
    "assignment-routing-assistance": (
        45.0, 35.0, 72.0, "high", False, False, "service_line_assignment_delay", False,
    ),
    "scheduling-coordination-assistance": (
        55.0, 35.0, 75.0, "high", False, True, "service_line_scheduling_retries", True,
    ),
    "handoff-reduction": (
        50.0, 35.0, 58.0, "moderate", False, False, "service_line_reassignment", True,
    ),
    "stuck-case-monitoring": (85.0, 65.0, 22.0, "low", True, True, None, False),
    "data-quality-ingestion-monitoring": (85.0, 65.0, 18.0, "low", True, True, None, False),
}
# --- fixed values: pattern rules ---------------------------------------------
# (rule, archetype, dimension, stage, finding types, process terms)
PATTERN_RULES = (
    (
        "rule-intake-completeness-v1",
        "intake-completeness-validation",
        "referral_source",
        "intake_completeness",
        ("lower_first_pass_completeness", "elevated_rework"),
        ("referral_source_rework_path", "Missing information", "missing_information"),
    ),
    (
        "rule-assignment-routing-v1",
        "assignment-routing-assistance",
        "service_line",
        "assignment",
        ("longer_assignment_wait",),
        ("service_line_assignment_delay", "Referral categorised -> Clinical team assigned"),
    ),
    (
        "rule-scheduling-coordination-v1",
        "scheduling-coordination-assistance",
        "service_line",
        "scheduling",
        ("elevated_failed_scheduling", "longer_booking_time", "elevated_rework"),
        ("service_line_scheduling_retries", "Scheduling failed", "failed_scheduling"),
    ),
    (
        "rule-handoff-reduction-v1",
        "handoff-reduction",
        "service_line",
        "assignment",
        ("elevated_reassignment", "elevated_handoffs"),
        ("service_line_reassignment", "Clinical team reassigned", "reassignment"),
    ),
)
# (rule, archetype, dimension, value, stage, evidence sources, terms)
VOLUME_RULES = (
    (
        "rule-stuck-case-monitoring-v1",
        "stuck-case-monitoring",
        "overall",
        "all_cases",
        "cross_workflow_monitoring",
        ("process_deviation", "cohort_metric"),
        ("missing_terminal_event", "stuck_case_rate", "is_stuck"),
    ),
    (
        "rule-data-quality-monitoring-v1",
        "data-quality-ingestion-monitoring",
        "source_system",
        "all_sources",
        "ingestion",
        ("baseline_quality", "process_quality"),
        ("delayed_ingestion", "out_of_order_ingestion", "duplicate_events"),
    ),
)
SEVERITY = {"low": 35.0, "moderate": 65.0, "high": 90.0}


def direction(observed: Column, baseline: Column | None = None) -> Column:
    if baseline is None:
        return F.when(observed.isNull(), "not_applicable").otherwise("present")
    return (
        F.when(observed.isNull(), "not_applicable")
        .when(baseline.isNull(), "present")
        .when(observed >= baseline, "elevated")
        .otherwise("lower")
    )


def _evidence(df: DataFrame, source: str, **columns) -> DataFrame:
    """Project any result table onto the evidence columns."""
    string, double = F.lit(None).cast("string"), F.lit(None).cast("double")
    default = {
        "dimension": string,
        "value": string,
        "materiality": string,
        "confidence": F.lit("high"),
        "warnings": F.lit(0),
        "sample_size": F.lit(None).cast("long"),
        "observed": double,
    }
    default |= columns
    fact = default.pop("fact", default["metric"])
    default["source_type"] = F.lit(source)
    default["evidence_id"] = stable_id("evidence-", 16, F.lit(source), default["record_id"], fact)
    default["observed"] = default["observed"].cast("double")
    default["sample_size"] = default["sample_size"].cast("long")
    return df.select(*[default[c].alias(c) for c in EVIDENCE])


def baseline_evidence(found: DataFrame, values: DataFrame, quality: DataFrame) -> DataFrame:
    """quality: (measure, cases, analysed) rows."""
    one = _evidence(
        found,
        "baseline_finding",
        record_id=F.col("finding_id"),
        metric=F.col("metric"),
        dimension=F.col("dimension"),
        value=F.col("value"),
        observed=F.col("observed"),
        sample_size=F.col("cohort_cases"),
        direction=direction(F.col("observed"), F.col("baseline")),
        materiality=F.col("materiality"),
        warnings=F.lit(2),
    )
    known = F.col("observed").isNotNull()
    two = _evidence(
        values,
        "cohort_metric",
        record_id=F.concat_ws(":", "dimension", "value"),
        metric=F.col("metric"),
        dimension=F.col("dimension"),
        value=F.col("value"),
        observed=F.col("observed"),
        sample_size=F.col("sample"),
        direction=direction(F.col("observed")),
        confidence=F.when(known, "high").otherwise("low"),
        warnings=F.when(known, 0).otherwise(1),
    )
    three = _evidence(
        quality,
        "baseline_quality",
        record_id=F.lit("quality"),
        metric=F.col("measure"),
        observed=F.col("cases"),
        sample_size=F.col("analysed"),
        direction=direction(F.col("cases")),
    )
    return one.unionByName(two).unionByName(three)


def process_evidence(
    candidates: DataFrame,
    stats: DataFrame,
    variants: DataFrame,
    deviations: DataFrame,
    quality: DataFrame,
) -> DataFrame:
    """variants: (variant_id, cases, class, markers array); deviations: (category, deviations, traces)."""
    parts = [
        _evidence(
            candidates,
            "process_candidate",
            record_id=F.col("candidate_id"),
            metric=F.col("candidate_type"),
            dimension=F.col("dimension"),
            value=F.col("value"),
            observed=F.col("frequency"),
            sample_size=F.col("cases"),
            direction=F.lit("elevated"),
            materiality=F.col("materiality"),
            warnings=F.lit(1),
        ),
        _evidence(
            stats,
            "process_transition",
            record_id=F.col("transition_id"),
            metric=F.concat_ws(" -> ", "source", "target"),
            fact=F.lit("median_elapsed_hours"),
            observed=F.col("hours_median"),
            sample_size=F.col("cases"),
            direction=direction(F.col("hours_median")),
        ),
        _evidence(
            variants.where(F.size("markers") > 0),
            "process_variant",
            record_id=F.col("variant_id"),
            metric=F.concat_ws(",", "markers"),
            fact=F.lit("markers"),
            observed=F.col("cases"),
            sample_size=F.col("cases"),
            direction=F.lit("present"),
            materiality=F.col("class"),
        ),
        _evidence(
            deviations,
            "process_deviation",
            record_id=F.col("category"),
            metric=F.col("category"),
            fact=F.lit("count"),
            observed=F.col("deviations"),
            sample_size=F.col("traces"),
            direction=F.lit("present"),
            confidence=F.lit("moderate"),
            warnings=F.lit(1),
        ),
        _evidence(
            quality,
            "process_quality",
            record_id=F.lit("quality"),
            metric=F.col("measure"),
            observed=F.col("cases"),
            sample_size=F.col("analysed"),
            direction=direction(F.col("cases")),
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def research_evidence(observations: DataFrame) -> DataFrame:
    """observations: flat rows, see sources.files.flatten_research."""
    return _evidence(
        observations,
        "research_observation",
        record_id=F.col("observation_id"),
        metric=F.col("reported_problem"),
        dimension=F.col("cohort_dimension"),
        value=F.col("cohort_value"),
        sample_size=F.lit(1),
        direction=F.when(F.size("contradicts") > 0, "mixed").otherwise("present"),
        materiality=F.col("severity"),
        confidence=F.lit("moderate"),
        warnings=F.lit(1),
    )


def evidence_registry(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def repeated_evidence(registry: DataFrame) -> DataFrame:
    """Identifiers that occur more than once (must be empty)."""
    return (
        registry.groupBy("evidence_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def evidence_quality(registry: DataFrame) -> DataFrame:
    return registry.groupBy("source_type", "confidence").agg(
        F.count(F.lit(1)).alias("records"), F.sum("warnings").alias("warnings")
    )


def contradiction_pairs(observations: DataFrame) -> DataFrame:
    """Each unordered pair of contradicting observations once."""
    pair = F.array_sort(F.array("observation_id", "other"))
    return (
        observations.select("observation_id", F.explode("contradicts").alias("other"))
        .select(pair[0].alias("left_id"), pair[1].alias("right_id"))
        .dropDuplicates()
        .select(
            stable_id("contradiction-", 16, F.col("left_id"), F.col("right_id")).alias(
                "contradiction_id"
            ),
            "left_id",
            "right_id",
        )
    )


def pattern_rules(spark: SparkSession, rules=PATTERN_RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r, a, d, s, list(f), list(t)) for r, a, d, s, f, t in rules],
        "rule_id string, archetype string, dimension string, stage string, "
        "finding_types array<string>, terms array<string>",
    )


def archetype_table(spark: SparkSession, profiles=ARCHETYPES) -> DataFrame:
    return spark.createDataFrame(
        [(a, *p) for a, p in profiles.items()],
        "archetype string, stable_rules double, integration double, risk double, "
        "risk_level string, prototype boolean, stable boolean, candidate_type string, "
        "counts_rework boolean",
    )


def _mentions(metric: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(metric, t))


def cohort_or_wildcard(
    targets: DataFrame, evidence: DataFrame, sources: tuple[str, ...]
) -> DataFrame:
    """Link targets (dimension, value, terms) to evidence of their cohort or of no cohort.

    Two branches: an equi join for evidence with a cohort, and, for evidence
    without one, a join on the mentioned term after every term list is exploded
    and each metric is reduced to its distinct text.
    """
    wanted = evidence.where(F.col("source_type").isin(*sources)).select(
        "evidence_id", F.col("metric").alias("e_metric"), "dimension", "value"
    )
    own = (
        targets.join(wanted.where(F.col("dimension").isNotNull()), ["dimension", "value"])
        .where(_mentions(F.col("e_metric"), F.col("terms")))
        .select("target_id", "evidence_id")
    )
    # the distinct (metric text, term) pairs are few: texts come from closed vocabularies
    free = wanted.where(F.col("dimension").isNull()).select("evidence_id", "e_metric")
    terms = targets.select(F.explode("terms").alias("term")).distinct()
    matched = (
        free.select("e_metric")
        .distinct()
        .join(terms, F.contains(F.col("e_metric"), F.col("term")))
        .join(free, "e_metric")
        .select("term", "evidence_id")
    )
    wild = (
        targets.select("target_id", F.explode("terms").alias("term"))
        .join(matched, "term")
        .select("target_id", "evidence_id")
    )
    return own.unionByName(wild).distinct()


def _opportunity(seeds: DataFrame, spec: OpportunitySpec) -> DataFrame:
    key = [F.col(c) for c in ("archetype", "dimension", "value", "stage")]
    return seeds.select(
        "target_id",
        "rule_id",
        "archetype",
        "dimension",
        "value",
        "stage",
        stable_id("opportunity-", 16, *key, F.lit(spec.rule_version)).alias("opportunity_id"),
    )


def pattern_seeds(
    found: DataFrame, evidence: DataFrame, rules: DataFrame, spec: OpportunitySpec
) -> tuple[DataFrame, DataFrame]:
    """Seeds, one per (rule, finding) with process evidence of the cohort, and their links.

    Links stay flat (target_id, evidence_id) rows: one seed may rest on any
    number of evidence records.
    """
    hits = (
        found.where(F.col("cohort_cases") >= spec.min_sample)
        .join(F.broadcast(rules), "dimension")
        .where(F.array_contains(F.col("finding_types"), F.col("finding_type")))
        .withColumn("target_id", F.concat_ws("|", "rule_id", "finding_id"))
    )
    process = cohort_or_wildcard(
        hits.select("target_id", "dimension", "value", "terms"), evidence, PROCESS_SOURCES
    )
    measured = cohort_or_wildcard(
        hits.select("target_id", "dimension", "value", F.array("metric").alias("terms")),
        evidence,
        ("baseline_finding", "cohort_metric"),
    )
    seeds = hits.join(process.select("target_id").distinct(), "target_id", "left_semi")
    links = process.unionByName(measured).distinct()
    return _opportunity(seeds, spec), links


def volume_seeds(
    volumes: DataFrame, evidence: DataFrame, spec: OpportunitySpec, rules=VOLUME_RULES
) -> tuple[DataFrame, DataFrame]:
    """volumes: (rule_id, volume).  A rule fires when its volume reaches the sample minimum."""
    seeds, links = [], []
    for rule, archetype, dim, value, stage, sources, terms in rules:
        target = volumes.where(
            (F.col("rule_id") == rule) & (F.col("volume") >= spec.min_sample)
        ).select(
            "rule_id",
            F.lit(archetype).alias("archetype"),
            F.lit(dim).alias("dimension"),
            F.lit(value).alias("value"),
            F.lit(stage).alias("stage"),
            F.lit(rule).alias("target_id"),
        )
        cohort = "all" if dim == "overall" else value  # the overall cohort is named 'all'
        seeds.append(target)
        links.append(
            cohort_or_wildcard(
                target.select(
                    "target_id",
                    "dimension",
                    F.lit(cohort).alias("value"),
                    F.array(*[F.lit(t) for t in terms]).alias("terms"),
                ),
                evidence,
                sources,
            )
        )
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return _opportunity(union(seeds), spec), union(links)


def research_links(seeds: DataFrame, observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Research evidence that names the seed's archetype and its cohort, or no cohort."""
    told = observations.select(
        F.col("observation_id").alias("record_id"),
        F.explode("supported_archetypes").alias("archetype"),
        F.col("cohort_dimension").alias("o_dim"),
        F.col("cohort_value").alias("o_val"),
    )
    ids = evidence.where(F.col("source_type") == "research_observation").select(
        "record_id", "evidence_id"
    )
    fits = F.col("o_dim").isNull() | (
        (F.col("o_dim") == F.col("dimension")) & (F.col("o_val") == F.col("value"))
    )
    return (
        seeds.select("target_id", "archetype", "dimension", "value")
        .join(told, "archetype")
        .where(fits)
        .join(ids, "record_id")
        .select("target_id", "evidence_id")
        .distinct()
    )


def dedup_seeds(seeds: DataFrame) -> DataFrame:
    """One row per archetype, cohort and stage, with the rules that led to it."""
    return seeds.groupBy("opportunity_id", "archetype", "dimension", "value", "stage").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.count(F.lit(1)).alias("merged"),
    )


def opportunity_links(
    seeds: DataFrame, quantitative: DataFrame, qualitative: DataFrame
) -> DataFrame:
    """(opportunity_id, kind, evidence_id): the union of the links of all merged seeds."""
    ids = seeds.select("target_id", "opportunity_id")

    def tag(links: DataFrame, kind: str) -> DataFrame:
        return ids.join(links, "target_id").select(
            "opportunity_id", F.lit(kind).alias("kind"), "evidence_id"
        )

    return tag(quantitative, "supports").unionByName(tag(qualitative, "qualifies")).distinct()


def observed_burden(
    seeds: DataFrame,
    summaries: DataFrame,
    candidates: DataFrame,
    volumes: DataFrame,
    archetypes: DataFrame,
    spec: OpportunitySpec,
    period_days: float | None = None,
) -> DataFrame:
    """Associated current burden per opportunity.

    A seed takes its own cohort's row, or the overall row when there is none.
    """
    wide = summaries.groupBy("dimension", "value").agg(
        F.max("cases").alias("cohort_cases"),
        F.max(F.when(F.col("metric") == "manual_touches", F.col("mean"))).alias("touches"),
        F.max(F.when(F.col("metric") == "handoffs", F.col("mean"))).alias("handoff_mean"),
    )
    measures = ("cohort_cases", "touches", "handoff_mean")
    overall = wide.where(F.col("dimension") == "overall").select(
        *[F.col(c).alias(f"o_{c}") for c in measures]
    )
    first = candidates.groupBy("candidate_type", "dimension", "value").agg(
        F.min_by(F.struct("frequency", "cases", "median_hours"), "candidate_id").alias("c")
    )
    vol = volumes.groupBy("rule_id").agg(F.max("volume").alias("volume"))
    got = (
        seeds.withColumn("rule_id", F.col("rule_ids")[0])
        .join(F.broadcast(archetypes), "archetype")
        .join(wide, ["dimension", "value"], "left")
        .crossJoin(F.broadcast(overall))  # one row
        .join(first, ["candidate_type", "dimension", "value"], "left")
        .join(F.broadcast(vol), "rule_id", "left")
        .withColumns({c: F.coalesce(c, f"o_{c}") for c in measures})
        .drop(*[f"o_{c}" for c in measures])
    )
    affected = F.when(F.col("candidate_type").isNull(), F.col("volume")).otherwise(
        F.least(F.col("c.frequency"), F.col("c.cases"))
    )
    # least() skips nulls; without a candidate nothing is affected
    affected = F.when(F.col("candidate_type").isNotNull() & F.col("c").isNull(), None).otherwise(affected)
    factor = 365.0 / period_days if spec.annualise and period_days else 1.0
    touches = F.col("touches") * F.col("affected")
    hours = touches * F.lit(spec.touch_minutes) / 60
    return got.withColumn("affected", affected.cast("double")).withColumns(
        {
            "affected_rate": F.try_divide(F.col("affected"), F.col("cohort_cases")),
            "period_cases": F.col("affected") * factor,
            "burden_touches": touches,
            "burden_hours": hours,
            "burden_cost": hours * F.lit(spec.cost_per_hour),
            "rework_events": F.when(F.col("counts_rework"), F.col("c.frequency")).cast("double"),
            "burden_handoffs": F.col("handoff_mean") * F.col("affected"),
            "delay_hours": F.col("c.median_hours"),
        }
    ).drop("c")


def _bounded(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(value, F.lit(0.0))))


def score_inputs(
    opportunities: DataFrame, links: DataFrame, evidence: DataFrame, related: DataFrame
) -> DataFrame:
    """Per opportunity: evidence counts, breadth, sample size, severity and contradictions."""
    pain = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    facts = evidence.select("evidence_id", "source_type", "sample_size", "materiality", "warnings")
    measured, told = F.col("kind") == "supports", F.col("kind") == "qualifies"
    got = (
        links.join(facts, "evidence_id")
        .groupBy("opportunity_id")
        .agg(
            F.count_if(measured).alias("quantitative"),
            F.count_distinct(F.when(measured, F.col("source_type"))).alias("source_types"),
            F.max(F.when(measured, F.col("sample_size"))).alias("max_sample"),
            F.count_if(measured & (F.col("warnings") > 0)).alias("warned"),
            F.count_if(told).alias("qualitative"),
            F.max(F.when(told, F.coalesce(pain[F.col("materiality")], F.lit(50.0)))).alias("pain"),
        )
    )
    against = related.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("contradictions"))
    zero = ["quantitative", "source_types", "max_sample", "warned", "qualitative", "contradictions"]
    return (
        opportunities.select("opportunity_id")
        .join(got, "opportunity_id", "left")
        .join(against, "opportunity_id", "left")
        .na.fill(0, zero)
        .na.fill(0.0, ["pain"])
    )


def value_score(burden: DataFrame) -> Column:
    parts = [
        _bounded(F.col("affected") / 5),
        _bounded(F.col("burden_touches") / 20),
        _bounded(F.col("rework_events") / 3),
        _bounded(F.col("delay_hours") / 2),
        F.col("pain"),
        _bounded(F.col("source_types") * 20.0),
    ]
    return sum(parts, F.lit(0.0)) / len(parts)


def confidence_score() -> Column:
    raw = (
        F.lit(35.0)
        + F.least(F.lit(30.0), F.col("source_types") * 10.0)
        + F.when(F.col("max_sample") >= 100, 15.0).otherwise(5.0)
        + F.least(F.lit(15.0), F.col("qualitative") * 5.0)
        - F.col("contradictions") * 12.0
        - F.least(F.lit(15.0), F.col("warned") * 2.0)
    )
    return _bounded(raw)


def readiness_score() -> Column:
    fixed = 90.0 + 75.0 + 90.0 + 90.0 + 90.0  # inputs, action, instruments, shadow, reversible
    review = F.when(F.col("qualitative") > 0, 85.0).otherwise(60.0)
    return (F.lit(fixed) + F.col("stable_rules") + F.col("integration") + review) / 8


# fixed values: the weights and limits in the scores above and the grades below
def _grade(score: Column, high: float, moderate: float) -> Column:
    return F.when(score >= high, "high").when(score >= moderate, "moderate").otherwise("low")


def eligibility_gates(spec: OpportunitySpec) -> dict[str, Column]:
    enough = F.col("quantitative") >= spec.min_quantitative
    clinical, sensitive = F.col("needs_judgement"), F.col("needs_sensitive")
    return {
        "administrative_scope": ~clinical,
        "evidence_sufficiency": enough,
        "data_availability": F.col("quantitative") > 0,
        "process_stability": F.col("stable"),
        "measurability": F.lit(True),
        "reversibility": F.lit(True),
        "human_oversight": F.lit(True),
        "auditability": F.lit(True),
        "clinical_exclusion": ~clinical,
        "sensitive_data_exposure": ~sensitive,
    }


def priority_rank(burden: DataFrame, inputs: DataFrame, spec: OpportunitySpec) -> DataFrame:
    """Scores, gates, section and position of every opportunity."""
    df = burden.join(inputs, "opportunity_id")
    for flag in ("needs_judgement", "needs_sensitive"):
        if flag not in df.columns:
            df = df.withColumn(flag, F.lit(False))
    df = df.withColumns(
        {
            "value_score": value_score(df),
            "confidence_score": confidence_score(),
            "readiness_score": readiness_score(),
        }
    )
    hard = F.col("needs_judgement") | F.col("needs_sensitive")
    status = (
        F.when(F.col("needs_judgement"), "out_of_scope")
        .when(F.col("needs_sensitive"), "ineligible")
        .when(F.col("quantitative") < spec.min_quantitative, "needs_more_evidence")
        .when(F.col("prototype"), "eligible_for_controlled_prototype")
        .otherwise("eligible_for_further_discovery")
    )
    gates = eligibility_gates(spec)
    passed = sum((F.when(c, 1).otherwise(0) for c in gates.values()), F.lit(0))
    score = (
        F.col("value_score") * spec.value_weight
        + F.col("readiness_score") * spec.readiness_weight
        + F.col("confidence_score") * spec.confidence_weight
        - F.col("risk") * spec.risk_weight
    )
    df = df.withColumns(
        {
            "value_class": _grade(F.col("value_score"), 70, 45),
            "confidence_class": _grade(F.col("confidence_score"), 75, 50),
            "readiness_class": _grade(F.col("readiness_score"), 75, 55),
            "gates_passed": passed,
            "eligibility": status,
            "priority": F.when(~hard, score),
        }
    )
    section = (
        F.when(hard, "blocked")
        .when(
            (F.col("eligibility") == "eligible_for_controlled_prototype")
            & (F.col("priority") >= spec.prototype_threshold),
            "controlled_prototype",
        )
        .otherwise("further_discovery")
    )
    order = F.when(F.col("section") == "controlled_prototype", 0).when(
        F.col("section") == "further_discovery", 1
    ).otherwise(2)
    # opportunities are archetypes × cohorts, a small aggregate of any log
    w = Window.partitionBy(F.col("section") == "blocked").orderBy(
        order, F.desc(F.coalesce("priority", F.lit(-1.0))), "opportunity_id"
    )
    return df.withColumn("section", section).withColumn(
        "position", F.when(F.col("section") != "blocked", F.row_number().over(w))
    )


def gate_rows(ranked: DataFrame, spec: OpportunitySpec) -> DataFrame:
    """One row per opportunity and gate: gate and passed, with the columns of the ranking."""
    gates = [F.struct(F.lit(name).alias("gate"), passed.alias("passed")) for name, passed in eligibility_gates(spec).items()]
    return ranked.select("*", F.inline(F.array(*gates)))


def select_best(ranked: DataFrame) -> DataFrame:
    return (
        ranked.where(
            (F.col("section") == "controlled_prototype")
            & (F.col("eligibility") == "eligible_for_controlled_prototype")
        )
        .orderBy(
            "risk",
            F.desc("readiness_score"),
            F.desc("confidence_score"),
            F.desc(F.coalesce("priority", F.lit(-1.0))),
            "opportunity_id",
        )
        .limit(1)
    )


def related_contradictions(links: DataFrame, evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """(opportunity_id, contradiction_id): contradictions that touch a linked observation."""
    told = links.where(F.col("kind") == "qualifies").join(
        evidence.select("evidence_id", "record_id"), "evidence_id"
    )
    ends = pairs.select(
        "contradiction_id", F.explode(F.array("left_id", "right_id")).alias("record_id")
    )
    return told.join(ends, "record_id").select("opportunity_id", "contradiction_id").distinct()


def evidence_network(
    opportunities: DataFrame, links: DataFrame, evidence: DataFrame, pairs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Node and link tables: supports, qualifies, contradicts."""
    used = links.select(
        F.col("evidence_id").alias("source_id"),
        F.col("opportunity_id").alias("target_id"),
        F.col("kind").alias("relation"),
    )
    refs = links.select("evidence_id").distinct()
    known = evidence.join(refs, "evidence_id", "left_semi")
    ids = known.where(F.col("source_type") == "research_observation")
    left = ids.select(F.col("record_id").alias("left_id"), F.col("evidence_id").alias("source_id"))
    right = ids.select(F.col("record_id").alias("right_id"), F.col("evidence_id").alias("target_id"))
    against = (
        pairs.join(left, "left_id")
        .join(right, "right_id")
        .select("source_id", "target_id", F.lit("contradicts").alias("relation"))
    )
    nodes = opportunities.select(
        F.col("opportunity_id").alias("node_id"),
        F.lit("opportunity").alias("node_type"),
        F.concat_ws(": ", "archetype", "value").alias("label"),
    ).unionByName(
        known.select(
            F.col("evidence_id").alias("node_id"),
            F.col("source_type").alias("node_type"),
            F.col("metric").alias("label"),
        )
    )
    return nodes, used.unionByName(against)
