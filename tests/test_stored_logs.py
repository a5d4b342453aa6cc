"""Logs stored in buckets of the case: no shuffle by case again, and the same results."""

from dataclasses import replace

import pytest

from traceloom.operators import mining
from traceloom.plans import queries_review, workspace
from traceloom.plans.workspace import Workspace, stored
from traceloom.sources.tables import session_log

FOLDER = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "case_id" in line]


def rows(df):
    exact = [c for c, kind in df.dtypes if kind != "double"]
    numbers = [c for c, kind in df.dtypes if kind == "double"]
    return {str([r[c] for c in exact]): [r[c] for c in numbers] for r in df.collect()}


def same(one, two):
    a, b = rows(one), rows(two.select(*one.columns))
    assert a.keys() == b.keys() and len(a) == one.count()
    for key, numbers in a.items():
        assert numbers == pytest.approx(b[key], nan_ok=True)


@pytest.fixture(scope="module")
def raw(spark):
    return session_log(spark, FOLDER)


def test_nothing_is_shuffled_by_case_again(spark, raw):
    ws = Workspace(raw, store=True)
    assert ws.scale.stored_by == "case_id"
    plog = mining.process_log(ws.log.events, ws.log.cases, mining.activity_mapping(spark), ws.spec, ws.scale)
    found = [plog, ws.rows, mining.transition_stats(ws.plog, ws.mspec, ws.scale), mining.activity_stats(ws.plog), mining.two_step_loops(ws.plog, ws.scale)]
    assert not any(exchanges(df) for df in found)
    plain = Workspace(raw)
    assert exchanges(plain.plog)
    for name in ("wide", "transitions", "case_variants", "rollup"):
        same(getattr(ws, name), getattr(plain, name))


def test_logs_with_too_large_cases_are_not_bucketed(spark, raw):
    scale = replace(raw.scale, limit=3)
    log = stored(replace(raw, scale=scale))
    assert log.scale.stored_by is None
    ws = Workspace(log, store=True)
    same(ws.transitions, Workspace(raw).transitions)


def small_table(spark, folder):
    """Three users, one with two sessions, one whose sessions have no case, a user of null and repeated ids."""
    rows = [
        (1, "2024-01-01 08:00:00", 7, "view", 1.5, 3),
        (2, "2024-01-01 09:00:00", 7, "click", None, 60),
        (2, "2024-01-01 09:00:00", 7, "click", None, 60),
        (3, "2024-01-03 09:00:00", 7, "purchase", 2.0, 10),
        (4, "2024-01-01 10:00:00", 39, "view", 2.0, 99),
        (5, "2024-01-01 10:00:00", 49, "signup", 0.0, 60),
        (6, "2024-01-01 11:00:00", None, "view", 0.0, 1),
    ]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, k int")
    events = events.selectExpr("event_id", "to_timestamp(ts) AS ts", "user_id", "event_type", "value", "to_json(struct(k)) AS props")
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_cases_are_taken_from_the_stored_events(spark, tmp_path, monkeypatch, limit):
    folder = small_table(spark, tmp_path)
    raw = session_log(spark, folder)
    raw = replace(raw, scale=replace(raw.scale, limit=limit))
    read = []
    for name in ("pin", "pin_by"):
        keep = getattr(workspace, name)
        monkeypatch.setattr(workspace, name, lambda df, *a, keep=keep, **k: read.append(df.inputFiles()) or keep(df, *a, **k))
    monkeypatch.setattr(workspace, "session_log", lambda *a: raw)
    log = Workspace.of_sessions(spark, folder, store=True).log
    assert [any("events.parquet" in f for f in files) for files in read] == [True, False]
    assert log.cases.count() == 3
    for got, want in ((log.events, raw.events), (log.cases, raw.cases)):
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_compare_process_reads_variants_and_effort_from_storage(spark, tmp_path):
    """The sequences of the part and the case metrics are worked out once, not once for every measure that reads them."""
    folder = small_table(spark, tmp_path)
    got = queries_review.compare_process(spark, folder)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_xor" not in plan and "sha2" not in plan
    assert got.count() == 15


def test_compare_process_works_out_no_waiting_times(spark, tmp_path, monkeypatch):
    folder = small_table(spark, tmp_path)
    plans = []
    for module in (workspace, queries_review):
        for name in ("pin", "pin_by"):
            if hasattr(module, name):
                keep = getattr(module, name)
                note = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())
                monkeypatch.setattr(module, name, lambda df, *a, keep=keep, **k: note(df) or keep(df, *a, **k))
    queries_review.compare_process(spark, folder)
    assert any("rework_count" in p for p in plans) and not any("next_work" in p for p in plans)
