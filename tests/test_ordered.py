"""Ordered scans, pairing, merging and quantiles: split form = plain form = brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from traceloom.functions.ordered import scan
from traceloom.functions.stats import first_ids, quantiles_by_rank, summarise
from traceloom.operators.contracts import asof_label
from traceloom.operators.intervals import fifo_pairs, merge_intervals, next_match
from traceloom.session import Scale

BASE = datetime(2024, 1, 1)


def hot_rows(n=400, seed=1):
    """One key holds most rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(6)}"
        rows.append((key, rnd.randrange(50), i, rnd.randrange(-3, 4), rnd.choice(["a", None, "b"])))
    return rows


@pytest.mark.parametrize("limit", [10_000, 25])
def test_scan_matches_loop(spark, limit):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t int, i int, v int, s string")
    got = scan(
        df,
        ["k"],
        ["t", "i"],
        Scale(len(rows), limit),
        position="pos",
        previous={"before": F.col("v")},
        following={"after": F.col("v")},
        running={"total": F.col("v")},
        peak={"top": F.col("v")},
        carry={"seen": F.col("s")},
        ahead={"next_s": F.col("s")},
        totals={"all": F.col("v")},
        highest={"best": F.col("v")},
    ).collect()
    by_key = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(row[0], []).append(row)
    found = {(r.k, r.i): r for r in got}
    assert len(found) == len(rows)
    for key, members in by_key.items():
        for p, (_, _, i, v, s) in enumerate(members):
            r = found[key, i]
            values = [m[3] for m in members]
            texts = [m[4] for m in members]
            assert r.pos == p
            assert r.before == (values[p - 1] if p else None)
            assert r.after == (values[p + 1] if p + 1 < len(values) else None)
            assert r.total == sum(values[: p + 1]) and r.top == max(values[: p + 1])
            assert r.seen == next((t for t in reversed(texts[: p + 1]) if t), None)
            assert r.next_s == next((t for t in texts[p + 1 :] if t), None)
            assert r["all"] == sum(values) and r.best == max(values)


def test_scan_with_null_keys(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(60)], "k string, i int")
    got = scan(df, ["k"], ["i"], Scale(60, 10), position="p").collect()
    assert len(got) == 60 and all(r.p == r.i // 2 for r in got)


@pytest.mark.parametrize("limit", [10_000, 20])
def test_fifo_matches_greedy(spark, limit):
    rnd = random.Random(5)
    rows, want = [], []
    for c in range(25):
        size = 60 if c == 0 else rnd.randrange(1, 12)
        kinds = [rnd.choice(["q", "a", "x"]) for _ in range(size)]
        at = [BASE + timedelta(hours=p) for p in range(size)]
        rows += [(f"c{c}", p, f"{p:03d}", k, at[p]) for p, k in enumerate(kinds)]
        used = set()
        for p, k in enumerate(kinds):
            if k == "q":
                hit = next((j for j in range(p + 1, size) if kinds[j] == "a" and j not in used), None)
                if hit is not None:
                    used.add(hit)
                want.append((f"c{c}", at[p], at[hit] if hit is not None else None))
    df = spark.createDataFrame(rows, "case_id string, pos int, event_id string, event_type string, event_at timestamp")
    got = fifo_pairs(df, "q", "a", Scale(len(rows), limit)).collect()
    assert sorted((r.case_id, r.request_at, r.response_at) for r in got if r.response_at) == sorted(
        w for w in want if w[2]
    )
    assert len(got) == len(want)
    nxt = next_match(df, "q", "a", "hit", Scale(len(rows), limit)).collect()
    assert len(nxt) == len(want)


@pytest.mark.parametrize("limit", [10_000, 15])
def test_merge_intervals(spark, limit):
    rnd = random.Random(9)
    rows = []
    for _ in range(120):
        key, s = rnd.choice(["hot", "hot", "cold"]), rnd.randrange(300)
        rows.append((key, s, s + rnd.randrange(0, 6)))
    want = set()
    for key in ("hot", "cold"):
        merged = []
        for s, e in sorted((s, e) for k, s, e in rows if k == key):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(key, s, e) for s, e in merged}
    df = spark.createDataFrame(rows, "k string, s int, e int")
    got = merge_intervals(df, "k", "s", "e", Scale(len(rows), limit)).collect()
    assert {(r.k, r.s, r.e) for r in got} == want
    assert sum(r.merged for r in got) == len(rows)


def test_quantiles_by_rank(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), float(rnd.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.g: r for r in summarise(df, ["g"], "v", (0.5, 0.9), Scale(300)).collect()}
    large = {r.g: r for r in summarise(df, ["g"], "v", (0.5, 0.9), Scale(300, 30)).collect()}
    assert set(exact) == set(large)
    for g, r in exact.items():
        assert large[g].n == r.n and large[g].median == pytest.approx(r.median)
        assert large[g].p90 == pytest.approx(r.p90)
    overall = quantiles_by_rank(df, [], "v", (0.5,), Scale(300, 30)).first()
    assert overall["_q0"] == pytest.approx(df.selectExpr("percentile(v, 0.5)").first()[0])


def test_first_ids(spark):
    df = spark.createDataFrame([("g", f"{i % 40:02d}") for i in range(200)], "g string, i string")
    assert first_ids(df, ["g"], "i", 3, "ids").first().ids == ["00", "01", "02"]


def test_value_ahead_is_linear_in_one_key(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("key"), F.col("id").alias("at"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    got = scan(rows, ["key"], ["at"], Scale(200_000), ahead={"next": F.col("v")})
    wrong = got.where(~F.col("next").eqNullSafe(F.when(F.col("at") < 199_000, (F.floor(F.col("at") / 1000) + 1) * 1000)))
    assert wrong.count() == 0


def test_labels_of_a_hot_case_without_pairs(spark):
    """10,000 facts and 10,000 overlapping labels of one case, against a plain search on a part."""
    micros = F.timestamp_micros
    labels = spark.range(10_000).select(
        F.lit("c").alias("case_id"), F.format_string("%05d", "id").alias("label_id"), micros(F.col("id") * 10).alias("valid_from"),
        F.when(F.col("id") % 50 != 0, micros(F.col("id") * 10 + (F.col("id") * 7) % 43)).alias("valid_until"), F.concat(F.lit("s"), "id").alias("status"),
    )
    facts = spark.range(10_000).select(F.lit("c").alias("case_id"), micros(F.col("id") * 9 - 50).alias("as_of"), "id")
    got = {r.id: r.label for r in asof_label(facts, labels).collect()}
    for i in range(0, 10_000, 97):
        t = i * 9 - 50
        open_ = [n for n in range(max(0, t // 10 - 60), 10_000) if n * 10 <= t and (n % 50 == 0 or t < n * 10 + n * 7 % 43)]
        assert got[i] == (f"s{max(open_)}" if open_ else "not_evaluable")


def test_split_quantiles_read_their_rows_once_a_column(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("v")).cache()
    df.count()
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = df.mapInArrow(noted, df.schema)
    got = {r.g: r for r in summarise(rows, ["g"], "v", (0.5, 0.9), Scale(300, 30)).collect()}
    assert seen.value <= 600  # one pass for the plain aggregates, one for the counts of values
    want = {r.g: r for r in summarise(df, ["g"], "v", (0.5, 0.9), Scale(300)).collect()}
    assert {g: r.asDict() for g, r in got.items()} == {g: r.asDict() for g, r in want.items()}
