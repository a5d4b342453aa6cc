"""Validation, sinks, audit chains, gates, scores and lineage on small fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom.operators import lineage, quality, review, whatif
from traceloom.operators import opportunities as op
from traceloom.session import Scale
from traceloom.sources import files, sinks
from traceloom.spec import BaselineSpec, MiningSpec, OpportunitySpec, ReviewSpec, Roles

from .ten_cases import frames

BASE = datetime(2024, 1, 1)


def test_case_and_event_validation(spark):
    events, cases = frames(spark)
    bad = cases.withColumn("closed_at", F.when(F.col("case_id") != "c0", F.col("closed_at")))
    checked = quality.validate_case_rows(bad, r"^CASE-[A-Z0-9]{4,32}$")
    valid, broken = quality.split_valid(checked)
    assert {r.case_id for r in broken.collect()} == {"c0"} and valid.count() == 9
    got = quality.validate_event_rows(
        events.withColumn("reason_code", F.lit("incorrect_category")), quality.reason_rules(spark)
    )
    counts = {r.code: r["rows"] for r in quality.violation_counts(got).collect()}
    # 5 requests, 2 failures, and one each of reassigned, no response, cancelled and rejected
    assert set(counts) == {"reason_not_allowed"} and counts["reason_not_allowed"] == 11


def test_forbidden_keys(spark):
    rows = [
        ('{"a": {"Patient-Name": 1}}', ["patient_name"]),
        ('{"list": [{"phone number": "x"}, {"ok": "diagnosis"}]}', ["phone_number"]),
        ('{"\\u0061ddress": 1}', ["address"]),
        ('{"note": "say \\"email\\": no"}', []),
        ("{}", []),
    ]
    df = spark.createDataFrame(rows, "text string, want array<string>")
    for r in quality.forbidden_key_scan(df, "text").collect():
        assert r.forbidden_keys == r.want, r.text


def test_text_patterns(spark):
    rows = [
        ("call 555-123-4567", {"pattern:phone"}),
        ("mail A.B@example.org", {"pattern:email"}),
        ("Patient ID: 7", {"pattern:identifier"}),
        ("a clinical URGENCY", {"term:clinical urgency"}),
        ("nothing here", set()),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = {r.t: set(r.findings) for r in quality.text_safety_scan(df, "t").collect()}
    assert got == dict(rows)


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("run", F.lit("x"))
    place = str(tmp_path / "out")
    sinks.write_tables({"a": df, "b": df}, place)
    with pytest.raises(FileExistsError):
        sinks.write_tables({"c": df, "b": df}, place)
    assert not sinks.path_exists(spark, f"{place}/c")  # checked before the first write
    runs = str(tmp_path / "runs")
    assert sinks.write_run(spark, runs, "r1", {"rows": df}, "f1") == "written"
    assert sinks.write_run(spark, runs, "r1", {"rows": df}, "f1") == "unchanged"
    with pytest.raises(ValueError):
        sinks.write_run(spark, runs, "r1", {"rows": df}, "f2")
    sinks.write_run(spark, runs, "r2", {"rows": df}, "f3")
    assert sinks.read_runs(spark, runs, "rows").count() == 10


def test_of_two_writers_one_is_published(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    runs, df = str(tmp_path / "runs"), spark.range(50).repartition(3)
    with ThreadPoolExecutor(4) as pool:
        said = list(pool.map(lambda _: sinks.write_run(spark, runs, "r", {"a": df, "b": df}, "f"), range(4)))
    assert sorted(said) == ["unchanged"] * 3 + ["written"]
    assert sinks.read_runs(spark, runs, "a").count() == sinks.read_runs(spark, runs, "b").count() == 50
    assert [tuple(r) for r in sinks.run_ledger(spark, runs).collect()] == [("r", "f", "completed", 100)]


def test_a_writer_that_dies_leaves_the_published_runs(spark, tmp_path):
    runs, df = str(tmp_path / "runs"), spark.range(5)
    sinks.write_run(spark, runs, "old", {"rows": df}, "f")
    bad = df.select(F.raise_error(F.lit("killed")).alias("id"))
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            sinks.write_run(spark, runs, "new", {"rows": df, "more": bad}, "g")
        assert sinks.read_runs(spark, runs, "rows").select("run_id").distinct().collect()[0][0] == "old"
    assert sinks.write_run(spark, runs, "new", {"rows": df, "more": df}, "g") == "written"
    assert sinks.read_runs(spark, runs, "rows").count() == 10 and sinks.read_runs(spark, runs, "more").count() == 5


@pytest.mark.parametrize("limit", [1000, 5])
def test_audit_chain(spark, limit):
    rows = [
        (f"{i:03d}", "one" if i % 4 else "two", 0, BASE + timedelta(minutes=i), "role", "act", f"o{i}")
        for i in range(40)
    ]
    records = spark.createDataFrame(
        rows, "audit_id string, chain_id string, seq long, occurred_at timestamp, actor_role string, action string, object_id string"
    )
    scale = Scale(40, limit)
    chain = review.audit_build(records, scale)
    clean = review.audit_summary(review.audit_verify(chain, scale)).first()
    assert clean.records == 40 and clean.chains == 2 and clean.broken_links == 0
    edited = chain.withColumn("action", F.when(F.col("audit_id") == "017", "x").otherwise(F.col("action")))
    assert review.audit_summary(review.audit_verify(edited, scale)).first().broken_links >= 1
    # a changed first record changes every later fingerprint of its chain
    first = records.withColumn("action", F.when(F.col("audit_id") == "001", "x").otherwise(F.col("action")))
    marks = lambda c: {r.audit_id: r.fingerprint for r in c.where("chain_id = 'one'").collect()}
    old, new = marks(chain), marks(review.audit_build(first, scale))
    assert len(old) == 30 and all(old[i] != new[i] for i in old)
    cut = chain.where("audit_id <> '017'")
    assert review.audit_summary(review.audit_verify(cut, scale)).first().broken_links >= 1


def test_gates(spark):
    names = {g[2] for g in review.GATES}
    good = {n: 0.0 for n in names} | {
        "detector_precision": 0.95, "detector_recall": 0.8, "audit_completeness": 1.0, "policy_compliance": 1.0,
        "deterministic_replay": 1.0, "system_availability": 1.0, "rollback_success_rate": 1.0,
    }
    table = review.gate_table(spark, ReviewSpec())

    def judge(values):
        metrics = spark.createDataFrame(list(values.items()), "metric string, number double")
        return review.gate_assessment(review.evaluate_gates(metrics, table)).first().assessment

    assert judge(good) == "ready"
    assert judge(good | {"detector_recall": 0.1}) == "revise_pilot_design"
    assert judge(good | {"audit_completeness": 0.5}) == "pause_due_to_stop_condition"


def test_fingerprint(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(200)], "a int, b string")
    one = lineage.dataset_fingerprint(df, ["a", "b"]).first()
    two = lineage.dataset_fingerprint(df.orderBy(F.rand(1)).repartition(5), ["b", "a"]).first()
    assert one == two and one.rows == 200
    twice = lineage.dataset_fingerprint(df.unionByName(df.limit(2)), ["a", "b"]).first()
    assert twice.fingerprint != one.fingerprint
    with pytest.raises(Exception, match="different inputs"):
        lineage.join_lineage(
            lineage.dataset_fingerprint(df, ["a"]), lineage.dataset_fingerprint(df, ["b"])
        ).collect()


def test_overlay_keeps_intervals(spark):
    events, cases = frames(spark)
    approved = whatif.with_hours(cases.where("case_id = 'c1'").select("case_id"), 0.5, 0.1)
    after = whatif.event_overlay(events, approved, Roles(), "run")
    rows = {r.source_event_id: r for r in after.where("case_id = 'c1'").collect()}
    old = {r.event_id: r for r in events.where("case_id = 'c1'").collect()}
    start = old["0101"].event_at
    assert rows["0102"].event_at == start + timedelta(hours=0.6) and not rows["0102"].manual
    assert rows["0103"].event_at == start + timedelta(hours=0.7) and rows["0103"].manual
    assert rows["0104"].event_at - rows["0103"].event_at == old["0104"].event_at - old["0103"].event_at
    assert rows["0105"].actor_type == "system"  # the recheck
    changes = whatif.change_log(events, after)
    checks = whatif.overlay_validation(events, after, cases, changes, approved, Scale(100)).collect()
    assert all(r["rows"] == 0 for r in checks)
    assert after.where("rule IS NULL").count() == events.where("case_id <> 'c1'").count() + 2


def test_scores(spark):
    table = op.archetype_table(spark)
    row = table.where("archetype = 'intake-completeness-validation'").crossJoin(
        spark.range(1).select(
            F.lit("o").alias("opportunity_id"), F.lit(100.0).alias("affected"), F.lit(400.0).alias("burden_touches"),
            F.lit(60.0).alias("rework_events"), F.lit(40.0).alias("delay_hours"),
        )
    )
    inputs = spark.createDataFrame(
        [("o", 6, 3, 120, 2, 1, 90.0, 1)],
        "opportunity_id string, quantitative long, source_types long, max_sample long, warned long, "
        "qualitative long, pain double, contradictions long",
    )
    got = op.priority_rank(row, inputs, OpportunitySpec()).first()
    # (20 + 20 + 20 + 20 + 90 + 60) / 6; 35 + 30 + 15 + 5 − 12 − 4; (435 + 75 + 35 + 85) / 8
    assert got.value_score == pytest.approx(230 / 6)
    assert got.confidence_score == pytest.approx(69)
    assert got.readiness_score == pytest.approx(78.75)
    assert got.priority == pytest.approx(0.4 * 230 / 6 + 0.25 * 78.75 + 0.25 * 69 - 4)
    assert got.gates_passed == 10 and got.eligibility == "eligible_for_controlled_prototype"


def test_spec_checks():
    with pytest.raises(ValueError):
        BaselineSpec(period_start=BASE, period_end=BASE)
    with pytest.raises(ValueError):
        BaselineSpec(percentiles=(0.9, 0.5))
    with pytest.raises(ValueError):
        OpportunitySpec(value_weight=0.9)
    with pytest.raises(ValueError):
        MiningSpec(rare_variant=5)


def test_run_selection(spark):
    events, cases = frames(spark)
    marked = events.withColumn(
        "metadata", F.when(F.col("case_id").isin("c1", "c2"), '{"generation_run_id": "r"}').otherwise("{}")
    )
    picked, owners = files.select_run(marked, cases, "r")
    assert {r.case_id for r in owners.collect()} == {"c1", "c2"}
    manifest = spark.createDataFrame([(2, picked.count())], "case_count long, event_count long")
    assert files.check_counts(picked, owners, manifest).first().complete
    wrong = spark.createDataFrame([(3, 1)], "case_count long, event_count long")
    with pytest.raises(Exception, match="manifest"):
        files.check_counts(picked, owners, wrong).collect()
    options = files.jdbc_options("jdbc:x", "(select 1) t", partition=("id", "0", "9", 3))
    assert options["numPartitions"] == "3" and options["partitionColumn"] == "id"
