"""The streaming detector over several files equals the batch form."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom.session import Scale
from traceloom.sources.files import read_jsonl, stream_snapshots
from traceloom.sources.sinks import write_rows
from traceloom.sources.snapshots import FORM_SCHEMA, SNAPSHOT_SCHEMA
from traceloom.spec import DetectorSpec
from traceloom.streaming import detector as det
from traceloom.streaming import monitors as mo

BASE = datetime(2024, 1, 10)


def snapshot(case, number, minutes, state, *, version=1, update="initial", superseded=None, warn=(), review="not_started"):
    at = BASE + timedelta(minutes=minutes)
    field = ("supporting_document", state, state != "not_applicable", at, "p", ["log"])
    return (
        f"{case}-{number}", case, at, at, "referral_portal", f"R{case}", version, "intake", "INTAKE-2",
        "requirements-v2", [field], list(warn), review, "fresh", "none", update, superseded, "p", ["log"], "d", 2,
    )


BATCHES = [
    [
        snapshot("a", 1, 0, "pending_source_update"),
        snapshot("b", 1, 0, "absent"),
        snapshot("c", 1, 0, "pending_source_update"),
        snapshot("d", 1, 0, "absent", warn=("supporting_document_missing",)),
        snapshot("e", 1, 5, "pending_source_update"),
    ],
    [
        snapshot("a", 2, 180, "absent", version=2),  # exactly at the due time: still in time
        snapshot("b", 2, 60, "absent", update="retry"),  # the same delivery again
        snapshot("b", 3, 90, "present", version=2, update="supersession", superseded="b-1"),
        snapshot("c", 2, 181, "unknown", version=2),  # after the due time
        snapshot("d", 2, 100, "verification_required", version=2, review="started"),
        snapshot("e", 2, 100, "unknown", version=2),  # leaves the timer running
    ],
    [snapshot("f", 1, 2000, "present")],
]


def forms(spark):
    return spark.createDataFrame([(0, "intake", "INTAKE-2", datetime(2024, 1, 1), None, [])], FORM_SCHEMA)


def rows(df):
    keep = ["case_id", "snapshot_id", "evaluated_at", "outcome", "reasons", "due_at"]
    return sorted(tuple(map(str, r)) for r in df.select(*keep).collect())


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i, batch in enumerate(BATCHES):
        df = spark.createDataFrame(batch, SNAPSHOT_SCHEMA).coalesce(1)
        write_rows(df, str(tmp_path / f"part{i}"))
        source.mkdir(exist_ok=True)
        (tmp_path / f"part{i}").joinpath("_SUCCESS").exists()
        name = next((tmp_path / f"part{i}").glob("*.json"))
        (source / f"{i}.json").write_bytes(name.read_bytes())
    everything = [s for batch in BATCHES for s in batch]
    batch = det.detect(
        spark.createDataFrame(everything, SNAPSHOT_SCHEMA), forms(spark), DetectorSpec(), Scale(100)
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mo.ROCKSDB)
    stream = det.detect_stream(stream_snapshots(spark, str(source), 1), forms(spark), DetectorSpec())
    assert rows(mo.run_to_end(stream)) == rows(batch)
    outcomes = {(r.snapshot_id, r.outcome): r.reasons for r in batch.collect()}
    assert ("a-1", "abstain") not in outcomes  # confirmed at the due time
    assert outcomes["c-1", "abstain"] == det.EXPIRED and outcomes["e-1", "abstain"] == det.EXPIRED
    assert outcomes["b-2", "no_recommendation"] == det.REPEATED
    assert ("b-3", "retract") in outcomes and ("d-1", "observe_only") in outcomes


@pytest.mark.parametrize("policy,outcome", [("apply_with_warning", "recommend"), ("abstain", "abstain")])
def test_late_policy(spark, tmp_path, policy, outcome):
    source = tmp_path / "in"
    source.mkdir()
    for i, snap in enumerate([snapshot("a", 1, 100, "present"), snapshot("a", 0, 50, "absent", version=3)]):
        write_rows(spark.createDataFrame([snap], SNAPSHOT_SCHEMA).coalesce(1), str(tmp_path / f"p{i}"))
        (source / f"{i}.json").write_bytes(next((tmp_path / f"p{i}").glob("*.json")).read_bytes())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mo.ROCKSDB)
    spec = DetectorSpec(late_policy=policy)
    got = mo.run_to_end(
        det.detect_stream(stream_snapshots(spark, str(source), 1), forms(spark), spec, "1 day")
    ).collect()
    late = next(r for r in got if r.snapshot_id == "a-0")
    assert late.late and late.outcome == outcome


def test_split_form(spark):
    everything = [s for batch in BATCHES for s in batch]
    df = spark.createDataFrame(everything, SNAPSHOT_SCHEMA)
    plain = det.detect(df, forms(spark), DetectorSpec(), Scale(100))
    split = det.detect(df, forms(spark), DetectorSpec(), Scale(100, 2))
    assert rows(plain) == rows(split)
    states = {r.case_id: r for r in det.final_states(plain).collect()}
    assert states["b"].retracted and not states["b"].active
    assert states["a"].active and states["c"].confirmation_miss


def test_bad_lines_are_reported(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"label_id": "1", "case_id": "c"}\n\n{"label_id": \n{"label_id": "2", "case_id": "d"}\n')
    good, bad = read_jsonl(spark, str(path), "label_id string, case_id string")
    assert {r.label_id for r in good.collect()} == {"1", "2"}
    assert bad.count() == 1 and "label_id" in bad.first().line
    assert good.select(F.count("*")).first()[0] == 2
