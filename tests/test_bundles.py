"""Nested bundles cut into records wherever their byte ranges lie."""

import json
from random import Random

import pytest

from traceloom.session import Scale
from traceloom.sources import files


def bundle(seed, events):
    r = Random(seed)
    odd = ['a"b', "}{", "\\", 'x\\"}', "é😀", "", "[{", "tab\t", '"}']
    cases = [{"case_id": f"c{i}", "status": r.choice(odd), "schema_version": i, "received_at": "2024-01-02T03:04:05Z"} for i in range(events // 5)]
    rows = [
        {"event_id": f"e{i}", "case_id": r.choice(odd), "reason_code": r.choice(odd), "metadata": json.dumps({"k": {"n": i}}), "manual": bool(i % 2), "extra": {"a": [{"b": {}}]}}
        for i in range(events)
    ]
    return {
        "configuration": {"seed": seed, "nested": {"x": [{"y": 1}]}}, "note": "}{", "cases": cases, "labels": [], "events": rows,
        "manifest": {"run_id": f"r{seed}", "case_count": len(cases), "event_count": len(rows)},
    }


@pytest.mark.parametrize("form", [dict(), dict(indent=2), dict(separators=(",", ":"), ensure_ascii=False)])
@pytest.mark.parametrize("limit", [100_000, 40])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, form, limit):
    one, two = bundle(1, 120), bundle(2, 33)
    path = tmp_path / "big.json"
    path.write_text(json.dumps(one, **form) + "\n" + json.dumps(two, **form), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 5
        good, bad = files.split_bundle(spark, str(path), Scale(5_000, limit))
        got = {name: df.collect() for name, df in good.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert bad.count() == 0 and got["labels"] == []
    for name, keys in (("cases", ("case_id", "status", "schema_version")), ("events", ("event_id", "case_id", "reason_code", "metadata", "manual"))):
        want = sorted(tuple(row[k] for k in keys) for b in (one, two) for row in b[name])
        assert sorted(tuple(r[k] for k in keys) for r in got[name]) == want
    assert sorted((r.run_id, r.event_count) for r in got["manifest"]) == [("r1", 120), ("r2", 33)]


def test_bad_records_are_kept_aside(spark, tmp_path):
    b = bundle(3, 12)
    b["events"][4]["event_at"] = "yesterday"
    b["cases"][0]["schema_version"] = "two"
    (tmp_path / "b.json").write_text(json.dumps(b))
    (tmp_path / "empty.json").write_text("")
    good, bad = files.split_bundle(spark, str(tmp_path))
    assert good["events"].count() == 11 and good["cases"].count() == 1 and good["manifest"].count() == 1
    assert sorted((r.entity, json.loads(r.text).get("event_id")) for r in bad.collect()) == [("cases", None), ("events", "e4")]


def test_records_are_cut_and_parsed_once(spark, tmp_path):
    b = bundle(4, 30)
    b["events"][3]["event_at"] = "yesterday"
    (tmp_path / "b.json").write_text(json.dumps(b))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cut = [line for line in plan(files.bundle_records(spark, str(tmp_path))).splitlines() if "transform(split(" in line]
    assert cut and not any("replace(" in line for line in cut)  # no count is worked out again for every part
    good, bad = files.split_bundle(spark, str(tmp_path))
    assert good["events"].count() == 29 and [json.loads(r.text)["event_id"] for r in bad.collect()] == ["e3"]
    assert not any("from_json" in plan(df) for df in (*good.values(), bad))
