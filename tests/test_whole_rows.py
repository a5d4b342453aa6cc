"""Queries that return more rows than their statements: every row of the operator, against plain Python."""

import operator
from collections import Counter

import __spark_entry__ as contract
from traceloom.operators import review
from traceloom.plans.queries_opportunity import portfolio
from traceloom.plans.queries_review import REVIEW, _workload

FOLDER = "/root/testdata/sf0.001"
COMPARE = {"<=": operator.le, ">=": operator.ge, "==": operator.eq}


def test_gates_cover_every_gate(spark):
    numbers = {r["metric"]: r["number"] for r in _workload(spark, FOLDER).collect()}
    want = {}
    for gate, _, metric, sign, limit, missing in review.GATES:
        limit = float(REVIEW.thresholds[limit]) if isinstance(limit, str) else limit
        actual = missing if numbers.get(metric) is None else numbers[metric]
        want[gate] = "pass" if actual is not None and COMPARE[sign](actual, limit) else "fail"
    got = contract.queries()["gates"](spark, FOLDER).collect()
    assert {r["gate"]: r["status"] for r in got} == want and len(got) == len(review.GATES)


def test_evidence_covers_every_source(spark):
    rows = portfolio(spark, FOLDER).evidence.select("evidence_id", "source_type", "record_id", "confidence").collect()
    got = contract.queries()["union_evidence"](spark, FOLDER).select("evidence_id", "source_type", "record_id", "confidence").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, rows))
    assert "process_quality" in {r["source_type"] for r in got}
    quality = contract.queries()["evidence_quality"](spark, FOLDER).collect()
    assert {(r["source_type"], r["confidence"]): r["records"] for r in quality} == Counter((r["source_type"], r["confidence"]) for r in rows)
    print("ROWS", len(got), len(quality))
