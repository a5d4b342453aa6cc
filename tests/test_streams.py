"""Streams with late rows, timers, state that can be read, and runs that go on."""

from collections import Counter
from dataclasses import astuple, replace
from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from tests.test_stream_detector import BASE, forms
from traceloom.session import Scale
from traceloom.sources.snapshots import SNAPSHOT_SCHEMA
from traceloom.spec import DetectorSpec
from traceloom.streaming import asof, resume, timers
from traceloom.streaming import detector as det
from traceloom.streaming import monitors as mo

STATES = ("absent", "present", "pending_source_update", "pending_source_update", "unknown", "verification_required")


def snapshots(seed, cases=6, each=30):
    """Arrivals of some cases, their source times up to two hours before or after."""
    r = Random(seed)
    rows = []
    for c in range(cases):
        at = BASE
        for n in range(each):
            at += timedelta(minutes=r.choice([1, 20, 45, 100, 200]))
            source = at - timedelta(minutes=r.choice([0, 0, 10, 50, 90, 120]))
            state = r.choice(STATES)
            field = ("supporting_document", state, True, at, "p", ["log"])
            superseded = f"{c}-{n - 1}" if r.random() < 0.7 else None
            rows.append((
                f"{c}-{n}", f"c{c}", at, source, "referral_portal", f"R{c}-{r.randrange(4)}", r.randrange(3), "intake", "INTAKE-2", "requirements-v2",
                [field], [], "not_started", "fresh", "none", r.choice(["initial", "retry", "supersession"]), superseded, "p", ["log"], "d", 2,
            ))
    return rows


def plain(df):
    return Counter(map(str, (tuple(r) for r in df.select(*det.COLUMNS).collect())))


@pytest.mark.parametrize(("policy", "allowed"), [("apply_with_warning", 60), ("abstain", 0), ("abstain", 600)])
def test_late_rows_are_put_in_order_or_treated_by_policy(spark, policy, allowed):
    rows = spark.createDataFrame(snapshots(3), SNAPSHOT_SCHEMA)
    spec = DetectorSpec(event_time="source_event_at", late_policy=policy, allowed_lateness_minutes=allowed, retry_days=1)
    with mo.state_store(spark):
        emitted = mo.replay(rows, "available_at", 4, lambda a: det.detect_stream(a, forms(spark), spec)).cache()
    end = rows.agg(F.max("available_at")).first()[0]
    batch = det.detect(rows, forms(spark), spec, Scale(1000), F.lit(end).cast("timestamp"))
    assert plain(det.settled(emitted)) == plain(batch)
    assert plain(det.detect(rows, forms(spark), spec, Scale(1000, 20), F.lit(end).cast("timestamp"))) == plain(batch)
    late = det.late_arrivals(emitted, spec).collect()
    done = Counter(r.done for r in late)
    assert all(r.mark > r.event_at and (r.done == "placed_by_event_time") == (r.behind_minutes <= allowed) for r in late)
    assert set(done) <= {"placed_by_event_time", "abstained" if policy == "abstain" else "applied_with_warning"} and sum(done.values()) > 20
    corrected = emitted.where("revision > 0")
    withdrawn = corrected.where(F.col("outcome") == det.WITHDRAWN).count()
    # without an allowance only a deadline that was over by the clock can turn out to have been met
    assert withdrawn > 0 and (corrected.count() > withdrawn or allowed < 600) and (corrected.count() == withdrawn or allowed > 0)


def state(spark, place, name):
    return spark.read.format("statestore").option("stateVarName", name).load(place)


def test_deliveries_are_forgotten(spark):
    first = snapshots(4, cases=3, each=10)
    shift = timedelta(days=9)
    later = [(f"{s[0]}x", "other", s[2] + shift, s[3] + shift, *s[4:]) for s in first[:1]]
    rows = spark.createDataFrame(first + later, SNAPSHOT_SCHEMA)
    place = mo.new_folder(spark, "t")
    with mo.state_store(spark):
        mo.replay(rows.where("case_id <> 'other'"), "available_at", 1, lambda a: det.detect_stream(a, forms(spark), DetectorSpec(retry_days=3)), checkpoint=place)
        held = state(spark, place, "seen").count()
        mo.replay(rows.where("case_id = 'other'"), "available_at", 1, lambda a: det.detect_stream(a, forms(spark), DetectorSpec(retry_days=3)), checkpoint=place)
        assert held == len({(s[1], s[5], s[6]) for s in first}) > 1
        assert [r.key.case_id for r in state(spark, place, "seen").collect()] == ["other"]


def at(hours):
    return BASE + timedelta(hours=hours)


def portions(spark, rows, schema, build, place=None):
    """Runs the stream over rows that carry the number of their portion last."""
    everything = spark.createDataFrame([r[:-1] for r in rows], schema)
    numbered = spark.createDataFrame([(*r[:-1], BASE + timedelta(days=r[-1])) for r in rows], f"{schema}, arrives timestamp")
    last = max(r[-1] for r in rows) + 1
    with mo.state_store(spark):
        got = mo.replay(numbered, "arrives", last, lambda a: build(a.drop("arrives")), checkpoint=place, cuts=[BASE + timedelta(days=d) for d in range(last - 1)])
    assert everything.count() == len(rows)
    return got


def test_stuck_cases(spark):
    rows = [
        ("a", "step", at(0), 0), ("a", "step", at(100), 0),  # the row between comes late and moves the deadline
        ("b", "step", at(0), 0), ("b", "end", at(5), 1),
        ("c", "step", at(1), 0), ("c", "step", at(200), 1),
        ("a", "step", at(40), 1),
        ("d", "step", at(150), 1), ("d", "other", at(151), 1), ("d", "step", at(190), 2),
        ("e", "step", at(400), 2),
    ]
    place = mo.new_folder(spark, "t")
    got = portions(spark, rows, "case_id string, event_type string, event_at timestamp", lambda a: timers.stuck(a, ("step",), ("end",), 48, "150 hours"), place)
    found = {(r.case_id, r.progress_at) for r in got.collect()}
    assert found == {("a", at(40)), ("a", at(100)), ("c", at(1)), ("c", at(200)), ("d", at(190))} - {("c", at(200)), ("d", at(190))} | set(
        (c, t) for c, t in [("c", at(200)), ("d", at(190))] if t + timedelta(hours=48) < at(250)
    )
    assert {r.key.case_id for r in state(spark, place, "spans").collect()} <= {"c", "d", "e"}


def test_drafts_expire(spark):
    rows = [
        ("u", "1", "opened", at(0), 0), ("u", "x", "decided", at(7), 0),
        ("u", "2", "opened", at(20), 0), ("u", "y", "decided", at(28), 0),  # at the deadline itself: expired
        ("u", "3", "opened", at(40), 0), ("u", "4", "opened", at(41), 1), ("u", "z", "decided", at(42), 1),
        ("v", "6", "decided", at(2), 0), ("v", "5", "opened", at(1), 1),  # the decision comes first
        ("w", "7", "opened", at(3), 0),
        ("w", "8", "opened", at(300), 2),
    ]
    place = mo.new_folder(spark, "t")
    got = portions(spark, rows, "owner string, id string, kind string, at timestamp", lambda a: timers.expired_drafts(a, 8, "50 hours"), place)
    assert {(r.draft_id, r.expires_at) for r in got.collect()} == {("2", at(28)), ("3", at(48)), ("7", at(11))}
    assert [r.key.owner for r in state(spark, place, "marks").collect()] == ["w"]


def test_a_late_row_merges_two_sessions(spark):
    rows = [("a", at(0), 0), ("a", at(20), 0), ("b", at(0), 0), ("b", at(20), 0), ("a", at(10), 1), (None, at(500), 2)]
    got = portions(spark, rows, "user string, ts timestamp", lambda a: mo.sessions(a, "user", "ts", "12 hours", "30 hours"))
    assert {(r.user, r.first_at, r.last_at, r.events) for r in got.collect() if r.user} == {
        ("a", at(0), at(20), 3), ("b", at(0), at(0), 1), ("b", at(20), at(20), 1)
    }


def test_what_was_known_can_be_asked_while_the_stream_runs(spark):
    schema = "case_id string, id string, event_at timestamp, known_at timestamp, status string"
    rows = [("a", "1", at(0), at(1), "new"), ("a", "2", at(5), at(30), "seen"), ("b", "3", at(4), at(4), "new"), ("a", "4", at(10), at(12), "done"), ("a", "1", at(0), at(50), "new")]
    place = mo.new_folder(spark, "t")
    told = []
    with mo.state_store(spark):
        for part in (rows[:1] + rows[2:3], rows[1:2] + rows[3:]):
            emitted = mo.replay(spark.createDataFrame(part, schema), "known_at", 1, asof.remember, checkpoint=place)
            told.append({(r.case_id, r.status) for r in emitted.collect()})
            known = asof.facts_known(spark, place)
            ask = lambda hours, valid=None: {
                r.case_id: (r.status, r.facts)
                for r in asof.as_of(known, F.lit(at(hours)).cast("timestamp"), valid and F.lit(at(valid)).cast("timestamp")).collect()
            }
            told.append((ask(2), ask(20), ask(40), ask(40, 6)))
    assert told[0] == {("a", "new"), ("b", "new")} and told[2] == {("a", "done")}
    assert told[1] == ({"a": ("new", 1)}, *[{"a": ("new", 1), "b": ("new", 1)}] * 3)
    b = {"b": ("new", 1)}
    assert told[3] == ({"a": ("new", 1)}, {"a": ("done", 2)} | b, {"a": ("done", 3)} | b, {"a": ("seen", 2)} | b)


def test_old_facts_go_but_answers_stay(spark):
    schema = "case_id string, id string, event_at timestamp, known_at timestamp, status string"
    rows = [("a", str(n), at(24 * n), at(24 * n + 1), f"s{n}") for n in range(10)] + [("z", "z", at(24 * 30), at(24 * 30), "end")]
    place = mo.new_folder(spark, "t")
    with mo.state_store(spark):
        mo.replay(spark.createDataFrame(rows, schema), "known_at", 2, lambda a: asof.remember(a, keep_days=5), checkpoint=place)
        known = asof.facts_known(spark, place)
    assert {(r.case_id, r.status) for r in known.collect()} == {("a", "s9"), ("z", "end")}


def test_runs_are_bound_to_their_versions(spark):
    rows = spark.createDataFrame(snapshots(7, cases=3), SNAPSHOT_SCHEMA)
    spec = DetectorSpec()
    versions = resume.Versions.of(spec, rows, "snapshots")
    build = lambda v: lambda a: det.detect_stream(a, forms(spark), spec, versions=astuple(v))
    cut, parted = mo.new_folder(spark, "t"), mo.new_folder(spark, "t")
    resume.check(spark, cut, versions)  # nothing there yet
    with mo.state_store(spark):
        one = mo.replay(rows, "available_at", 1, build(versions), checkpoint=cut)
        two = mo.replay(rows, "available_at", 2, build(versions), checkpoint=parted)
    assert plain(one) == plain(two)
    a, b = ({r.case_id: (r.fingerprint, r.active, r.pending, r.policy) for r in resume.checkpoint_record(spark, p).collect()} for p in (cut, parted))
    assert a == b and len(a) == 3
    resume.check(spark, cut, versions)
    other = resume.Versions.of(replace(spec, confirm_minutes=5), rows, "snapshots")
    with pytest.raises(resume.VersionMismatch, match="policy"):
        resume.check(spark, cut, other)
    with pytest.raises(resume.VersionMismatch, match="source"):
        resume.check(spark, cut, resume.Versions.of(spec, rows.drop("declaration"), "snapshots"))
    assert [tuple(r)[:3] for r in resume.bound_to(spark, cut).collect()] == [astuple(versions)] and isinstance(at(1), datetime)
