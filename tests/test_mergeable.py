"""Summaries that combine: as-of labels over chunks of a case, sequences hashed in any order."""

import hashlib
import json
from datetime import datetime, timedelta
from itertools import product
from random import Random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import contracts, variants
from traceloom.session import Scale
from traceloom.spec import MiningSpec

DAY = datetime(2024, 1, 1)


def intervals(seed, many):
    r = Random(seed)
    labels = []
    for n in range(many):
        start = DAY + timedelta(minutes=r.randrange(400))
        until = None if r.random() < 0.02 else start + timedelta(minutes=r.choice([0, 1, 3, 40, 300]))
        labels.append((f"L{n:04d}", "hot" if n % 4 else "cold", start, until, f"s{n}"))
    labels += [("L0000", "hot", DAY, None, "s0"), ("Lx", None, DAY, None, "s"), ("Ly", "hot", None, None, "s")]
    facts = [(n, r.choice(["hot", "cold", "none"]), DAY + timedelta(minutes=r.randrange(-5, 500))) for n in range(many)] + [(-1, "hot", None)]
    return labels, facts


def plain_label(labels, case, at):
    open_ones = [(start, name, status) for name, c, start, until, status in labels if at and c == case and start and start <= at and (until is None or at < until)]
    return max(open_ones)[2] if open_ones else "not_evaluable"


@pytest.mark.parametrize(("seed", "chunk", "fan"), [(1, 256, 64), (2, 8, 64), (3, 4, 3), (4, 1, 2)])
def test_labels_over_chunks_of_a_case(spark, seed, chunk, fan):
    labels, facts = intervals(seed, 160)
    l = spark.createDataFrame(labels, "label_id string, case_id string, valid_from timestamp, valid_until timestamp, status string")
    f = spark.createDataFrame(facts, "id int, case_id string, as_of timestamp")
    for scale in (None, Scale(400, 50)):
        got = {r.id: r.label for r in contracts.asof_label(f, l, scale, chunk, fan).collect()}
        assert got == {i: plain_label(labels, c, at) for i, c, at in facts}


def test_labels_start_no_python(spark):
    labels, facts = intervals(5, 20)
    l = spark.createDataFrame(labels, "label_id string, case_id string, valid_from timestamp, valid_until timestamp, status string")
    f = spark.createDataFrame(facts, "id int, case_id string, as_of timestamp")
    plan = contracts.asof_label(f, l, Scale(100))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan


def sequences():
    out = {f"{''.join(s)}-{n}": s for s in product("ab", repeat=3) for n in range(2)}
    return out | {"e": ("a", "b") * 300, "f": ("a", "b") * 300, "g": ("b", "a") * 300, "q": ('say "é"',)}


@pytest.mark.parametrize("scale", [Scale(10_000), Scale(10_000, 100)])
def test_variants_are_sequences(spark, scale):
    cases = sequences()
    rows = [(c, p, a) for c, s in cases.items() for p, a in enumerate(s)]
    Random(1).shuffle(rows)
    log = spark.createDataFrame(rows, "case_id string, pos long, activity string")
    got = {r.case_id: (r.variant_id, r.length) for r in variants.case_variants(log, MiningSpec(), scale).collect()}
    version = MiningSpec().mapping_version

    def name(s):
        text = json.dumps({"activities": list(s), "activity_mapping_version": version}, separators=(",", ":"), ensure_ascii=False)
        return "variant-" + hashlib.sha256(text.encode()).hexdigest()

    assert got == {c: (name(s), len(s)) for c, s in cases.items()}


def test_a_sequence_splits_anywhere(spark):
    """Keys of parts of a case combine to the key of the case, and short logs need no Python worker."""
    rows = [("c", p, f"a{p % 7}") for p in range(1000)]
    log = spark.createDataFrame(rows, "case_id string, pos long, activity string")
    one = variants.sequence_keys(log.coalesce(1)).first().key
    many = variants.sequence_keys(log.repartition(17, F.rand(3))).first().key
    assert one == many
    plan = variants.case_variants(log, MiningSpec(), Scale(1000))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
