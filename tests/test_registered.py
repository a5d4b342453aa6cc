"""A selection of registered queries against their check statements at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SELECTED = (
    "sessionise case_metrics m_waiting_time join_fifo_pairing interval_merge business_hours findings transition_stats "
    "variants complexity token_replay strict_deviations contradictions snapshot_validation contract_quality "
    "stream_detector_batch observability_taxonomy event_overlay audit_build dataset_fingerprint confusion_metrics "
    "join_asof_label workload_metrics log_quality stream_stuck variant_conformance"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    return value if isinstance(value, (bool, int, str)) or value is None else str(value)


@pytest.mark.parametrize("name", SELECTED)
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=2e-5) if isinstance(x, float) else x == y


def test_contract_shape(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert {"source", "target", "frequency"} <= set(df.columns) and df.count() > 0
