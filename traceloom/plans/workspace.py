"""The analyses composed over one log; every table is a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bottlenecks as bn
from ..operators import cohorts, conformance, mining, opportunities, quality, variants
from ..operators.metrics import case_metrics
from ..operators.timeline import case_flags, timeline
from ..session import Scale, pin, pin_by
from ..sources.tables import EventLog, session_cases, session_log
from ..spec import (
    BaselineSpec,
    Calendar,
    MiningSpec,
    OpportunitySpec,
    ReferenceModel,
    governed_model,
    strict_model,
)

UTC = Calendar(zone="UTC")
BASELINE = BaselineSpec(cutoff=datetime(2024, 2, 15), calendar=UTC)
MINING = MiningSpec(calendar=UTC)


def stored(log: EventLog, cases_of: Callable[[DataFrame], DataFrame] | None = None) -> EventLog:
    """The log written to the shared folder: in buckets of the case, unless a case may be too large for a task.

    cases_of: how the log's cases come from its events alone.  They are then taken from the stored
    events, so what the events are derived from is worked out once.
    """
    if not log.scale.fits("case_id"):
        events = pin(log.events)
        return EventLog(events, pin(cases_of(events) if cases_of else log.cases), log.scale, stored=True)
    scale = replace(log.scale, stored_by="case_id")
    events = pin_by(log.events, "case_id")
    cases = pin_by(cases_of(events), "case_id", spread=False) if cases_of else pin_by(log.cases, "case_id")
    return EventLog(events, cases, scale, stored=True)


class Workspace:
    """Baseline, mining and opportunity tables of one event log.

    With ``store=True`` the tables that several others read (the log itself, case
    metrics, process log, variant steps and their replay) are written to the
    shared folder once and read back from there.
    """

    def __init__(
        self,
        log: EventLog,
        baseline: BaselineSpec = BASELINE,
        mining_spec: MiningSpec = MINING,
        *,
        strict: ReferenceModel | None = None,
        governed: ReferenceModel | None = None,
        store: bool = False,
    ) -> None:
        if store and not log.stored:
            log = stored(log)
        self.log, self.spec, self.mspec, self.store = log, baseline, mining_spec, store
        self.strict, self.governed = strict or strict_model(), governed or governed_model()
        self.spark = log.events.sparkSession

    @classmethod
    def of_sessions(cls, spark: SparkSession, folder: str, *, store: bool = False, **options) -> "Workspace":
        log = session_log(spark, folder)
        return cls(stored(log, session_cases) if store else log, store=store, **options)

    @property
    def scale(self) -> Scale:
        return self.log.scale

    def _kept(self, df: DataFrame, by_case: bool = False) -> DataFrame:
        if not self.store:
            return df
        return pin_by(df, "case_id", spread=False) if by_case and self.scale.stored_by else pin(df)

    # --- baseline ---------------------------------------------------------
    @cached_property
    def rows(self) -> DataFrame:
        return timeline(self.log.events, self.log.cases, self.spec, self.scale)

    @cached_property
    def flags(self) -> DataFrame:
        return case_flags(self.log.events, self.log.cases, self.spec, self.scale)

    @cached_property
    def wide(self) -> DataFrame:
        return self._kept(case_metrics(self.log.events, self.log.cases, self.spec, self.scale), by_case=True)

    @cached_property
    def rollup(self) -> DataFrame:
        return cohorts.cohort_rollup(self.wide, self.spec)

    @cached_property
    def summaries(self) -> DataFrame:
        return self._kept(cohorts.cohort_summaries(self.wide, self.spec, self.scale))

    @cached_property
    def values(self) -> DataFrame:
        return self._kept(cohorts.cohort_values(self.rollup, self.summaries, self.spec))

    @cached_property
    def findings(self) -> DataFrame:
        return self._kept(cohorts.findings(self.values, cohorts.finding_rules(self.spark), self.spec))

    # --- process ----------------------------------------------------------
    @cached_property
    def plog(self) -> DataFrame:
        mapping = mining.activity_mapping(self.spark)
        return self._kept(
            mining.process_log(self.log.events, self.log.cases, mapping, self.spec, self.scale), by_case=True
        )

    @cached_property
    def transitions(self) -> DataFrame:
        return self._kept(mining.transition_stats(self.plog, self.mspec, self.scale))

    @cached_property
    def case_variants(self) -> DataFrame:
        return self._kept(variants.case_variants(self.plog, self.mspec, self.scale))

    @cached_property
    def cores(self) -> DataFrame:
        return variants.variant_cores(self.case_variants, self.mspec)

    @cached_property
    def steps(self) -> DataFrame:
        return self._kept(variants.variant_events(self.plog, self.cores))

    @cached_property
    def variants(self) -> DataFrame:
        return self._kept(variants.variants(self.case_variants, self.wide, self.mspec, self.scale))

    @cached_property
    def markers(self) -> DataFrame:
        return variants.variant_markers(self.steps, self.mspec)

    @cached_property
    def strict_replay(self) -> DataFrame:
        return conformance.token_replay(self.steps, self.strict)

    @cached_property
    def governed_replay(self) -> DataFrame:
        return self._kept(conformance.token_replay(self.steps, self.governed))

    @cached_property
    def strict_deviations(self) -> DataFrame:
        return conformance.strict_deviations(self.steps, self.strict, self.scale)

    @cached_property
    def governed_deviations(self) -> DataFrame:
        return self._kept(conformance.governed_deviations(self.steps, self.governed_replay, self.governed))

    @cached_property
    def strict_status(self) -> DataFrame:
        return conformance.conformance_status(self.strict_replay, self.strict_deviations)

    @cached_property
    def governed_status(self) -> DataFrame:
        return conformance.conformance_status(
            self.governed_replay, self.governed_deviations, ("scheduling_retry",)
        )

    def results(self, status: DataFrame) -> DataFrame:
        """Case-level conformance with the case attributes."""
        attrs = self.plog.where(F.col("pos") == 0).select("case_id", *mining.CASE_ATTRIBUTES)
        return conformance.case_conformance(self.case_variants, status).join(attrs, "case_id")

    @cached_property
    def candidates(self) -> DataFrame:
        parts = [
            bn.cohort_candidates(self.plog, self.mspec, self.scale),
            bn.assignment_candidates(self.plog, self.mspec, self.scale),
            bn.slow_transitions(self.transitions, self.mspec, self.scale),
            bn.slow_variants(self.variants, self.mspec, self.scale),
            bn.nonconforming_duration(
                self.plog,
                conformance.case_conformance(self.case_variants, self.governed_status),
                self.mspec,
                self.scale,
            ),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return self._kept(out)

    @cached_property
    def deviations(self) -> DataFrame:
        return conformance.deviation_counts(self.cores, self.governed_deviations)


class Portfolio:
    """Opportunities of a workspace, given research observations."""

    def __init__(
        self, ws: Workspace, observations: DataFrame, spec: OpportunitySpec = OpportunitySpec()
    ) -> None:
        self.ws, self.observations, self.spec = ws, observations, spec

    @cached_property
    def _coverage(self) -> DataFrame:
        one = quality.analysis_quality(self.ws.wide)
        total = one.where(F.col("measure") == "cases_analysed").select(F.col("cases").alias("analysed"))
        return one.crossJoin(F.broadcast(total))  # one row

    @cached_property
    def evidence(self) -> DataFrame:
        ws, names = self.ws, {"delayed_ingestion": "delayed_ingestion_cases", "out_of_order_ingestion": "out_of_order_ingestion_cases"}
        rename = F.create_map(*[x for a, b in names.items() for x in (F.lit(a), F.lit(b))])
        base_quality = self._coverage.where(F.col("measure").isin(*names)).withColumn(
            "measure", rename[F.col("measure")]
        )
        log_quality = quality.log_quality(ws.log.events, ws.log.cases, ws.spec, ws.scale)
        process_quality = log_quality.select(
            F.inline(
                F.array(
                    F.struct(F.lit("duplicate_events_excluded").alias("measure"), F.col("duplicate_events").alias("cases")),
                    F.struct(
                        F.lit("out_of_order_ingestion_cases").alias("measure"),
                        F.col("out_of_order_cases").alias("cases"),
                    ),
                )
            ),
            F.col("traces_included").alias("analysed"),
        )
        tagged = ws.cores.join(ws.markers, "variant_id")
        deviations = ws.deviations.crossJoin(F.broadcast(mining.trace_count(ws.plog)))
        return pin(
            opportunities.evidence_registry(
                opportunities.baseline_evidence(ws.findings, ws.values, base_quality),
                opportunities.process_evidence(
                    ws.candidates, ws.transitions, tagged, deviations, process_quality
                ),
                opportunities.research_evidence(self.observations),
            )
        )

    @cached_property
    def volumes(self) -> DataFrame:
        """(rule_id, volume): stalled cases, and cases with late or disordered events."""
        stalled = self.ws.deviations.where(F.col("category") == "missing_terminal_event").select(
            F.lit("rule-stuck-case-monitoring-v1").alias("rule_id"), F.col("deviations").alias("volume")
        )
        late = (
            self._coverage.where(F.col("measure").isin("delayed_ingestion", "out_of_order_ingestion"))
            .agg(F.max("cases").alias("volume"))
            .select(F.lit("rule-data-quality-monitoring-v1").alias("rule_id"), "volume")
        )
        return stalled.unionByName(late)

    @cached_property
    def pairs(self) -> DataFrame:
        return opportunities.contradiction_pairs(self.observations)

    @cached_property
    def _seeded(self) -> tuple[DataFrame, DataFrame]:
        rules = opportunities.pattern_rules(self.ws.spark)
        one = opportunities.pattern_seeds(self.ws.findings, self.evidence, rules, self.spec)
        two = opportunities.volume_seeds(self.volumes, self.evidence, self.spec)
        return pin(one[0].unionByName(two[0])), one[1].unionByName(two[1])

    @property
    def seeds(self) -> DataFrame:
        return self._seeded[0]

    @cached_property
    def opportunities(self) -> DataFrame:
        return opportunities.dedup_seeds(self.seeds)

    @cached_property
    def links(self) -> DataFrame:
        told = opportunities.research_links(self.seeds, self.observations, self.evidence)
        return opportunities.opportunity_links(self.seeds, self._seeded[1], told)

    @cached_property
    def burden(self) -> DataFrame:
        return opportunities.observed_burden(
            self.opportunities,
            self.ws.summaries,
            self.ws.candidates,
            self.volumes,
            opportunities.archetype_table(self.ws.spark),
            self.spec,
        )

    @cached_property
    def inputs(self) -> DataFrame:
        related = opportunities.related_contradictions(self.links, self.evidence, self.pairs)
        return opportunities.score_inputs(self.opportunities, self.links, self.evidence, related)

    @cached_property
    def ranked(self) -> DataFrame:
        return opportunities.priority_rank(self.burden, self.inputs, self.spec)
