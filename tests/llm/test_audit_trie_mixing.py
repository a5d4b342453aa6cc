"""Filter audit, conversation trie and source mixing against plain versions, and their edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from itertools import permutations
from random import Random

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract
from tests.llm.test_corpus import SMALL
from traceloom.llm import filter_audit, mixing, prefix_trie

# filter audit

DOCS = "doc_id long, text string, lang string, mask string, id string, part string, n string, digest string"


def plain_failures(rows):
    first = {}
    for id, text, *_ in rows:
        if id is not None:
            first[text or ""] = min(id, first.get(text or "", id))
    out = []
    for id, text, *_ in rows:
        text = text or ""
        words = text.encode().split()
        upper = sum("A" <= c <= "Z" for c in text)
        out.append({
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * upper > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": id is not None and first[text] < id,
        })
    return out


def plain_audit(rows, labels):
    """Every order walked document by document; shares by summing over the orders."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    failed, out, share = plain_failures(rows), {}, Counter()
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                removed = [r for r, f in left if f[k]]
                left = [(r, f) for r, f in left if not f[k]]
                failing = sum(f[k] for _, f in own)
                only = sum(f[k] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), step] = [
                    len(left), len(removed), failing - len(removed), only, sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)
                ]
                share[part, k] += len(removed)
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.fixture(scope="module")
def audited():
    r = Random(5)
    bodies = [None, "", " \n", "a#b", "ÄÖ " * 250, "X" * 50, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i % 90} É$" for i in range(300)), "  a b"]
    rows = [(i if i % 11 else None, r.choice(bodies), r.choice(["en", "", None, "de"])) for i in range(140)]
    rows += rows[3:9]
    rows.append((500, " ".join(f"v{i}" for i in range(100_000)), "en"))
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in r.sample(range(140), 80)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit_matches_walking_every_order(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.patterns(docs, marks)).collect()
    want = plain_audit(rows, labels)
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == want and len(got) == len(want) == 3 * 600


def test_audit_of_nothing(spark, audited):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.patterns(docs, labels)).count() == 0
    some = spark.createDataFrame([(*r, *["x"] * 5) for r in audited[0][:5]], DOCS)
    assert filter_audit.audit(filter_audit.patterns(some, labels)).where("good_lost <> 0 or toxic_lost <> 0").count() == 0


@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_conversation_prefix_trie"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(contract.oracle_sql()[name])
    names = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    df = contract.queries()[name](spark, SMALL)
    assert sorted(df.columns) == names and Counter(map(tuple, df.select(*names).collect())) == want


# conversation trie


def plain_rebuilt(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]  # the sign of % is SQL's
    return out


def plain_trie(seqs):
    nodes = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def some_turns(seed, convs):
    r = Random(seed)
    turns = []
    for c in range(0, convs):
        if r.random() < 0.1:
            continue
        kind = r.random()
        length = r.choice([1, 2, 3, 9, 12, 30]) if kind < 0.9 else 120
        for t in range(length):
            turns.append((c, t, r.choice(["user", "bot"]) if kind < 0.3 else "user", f"é{t % 7}" if kind < 0.7 else f"{t}:{r.randrange(2)}"))
    turns += [(c, None, None, None) for c in range(0, convs, 7)] + [(None, 1, "user", "x"), (-3, 0, "user", "é0"), (convs + 4, 2, "user", "é0")]
    r.shuffle(turns)
    return turns


@pytest.mark.parametrize(("seed", "convs", "block"), [(1, 200, 1000), (1, 200, 9), (2, 90, 1), (3, 60, 2), (4, 1, 5)])
def test_trie_matches_counting_prefixes(spark, seed, convs, block):
    turns = some_turns(seed, convs)
    table = spark.createDataFrame([(*t, "x", "y") for t in turns], "conv_id long, turn long, role string, text string, key string, block string")
    rebuilt = prefix_trie.rebuilt(prefix_trie.sequences(table))
    want = plain_rebuilt(turns)
    assert {r["conv"]: len(r["turns"]) for r in rebuilt.collect()} == {c: len(s) for c, s in want.items()}
    got = prefix_trie.trie(rebuilt, block).collect()
    assert Counter(map(tuple, got)) == plain_trie(want)


def test_trie_of_copies_and_of_turnless_conversations(spark):
    kind = "conv long, turns array<struct<digest: binary, bytes: bigint>>"
    copies = {c: [("u", "abc"), ("u", "d")] for c in range(40)}
    rows = [(c, [(hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1])) for t in s]) for c, s in copies.items()]
    for block in (1, 7, 100):
        assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, kind), block).collect())) == plain_trie(copies)
        bare = prefix_trie.trie(spark.createDataFrame([(c, []) for c in range(20)], kind), block).collect()
        assert Counter(map(tuple, bare)) == plain_trie({c: [] for c in range(20)})
    assert prefix_trie.trie(spark.createDataFrame([], kind)).count() == 0


def test_sparse_table_searches():
    r = np.random.default_rng(3)
    values = r.integers(0, 6, 77)
    table = prefix_trie.Ranges(values)
    for at in range(77):
        for depth in range(7):
            right = at
            while right + 1 < 77 and values[right + 1] >= depth:
                right += 1
            left = at
            while left >= 1 and values[left] >= depth:
                left -= 1
            one, d = np.array([at]), np.array([depth])
            assert table.right(one, d)[0] == right and table.left(one, d)[0] == left
            assert table.least(np.array([left]), np.array([right]))[0] == values[left : right + 1].min()


# source mixing


def plain_targets(sizes: dict, share=1.5, most=2):
    """Shares by weight; what is above the most is handed on until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > most * sizes[s]}
        if not over:
            out |= {s: weight[s] * unit for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def mixed_rows(seed):
    r = Random(seed)
    sources = ["b", "a", "Z", "", None, "é", "😀", "ｚ", "hot"]
    rows = [(i if i % 13 else None, " ".join(["w"] * r.choice([0, 1, 5, 60, 400])) or r.choice([None, "", " "]), r.choice(sources[:8])) for i in range(400)]
    rows += [(1000 + i, "x " * r.randrange(50), "hot") for i in range(300)] + [(3000, "y " * 30_000, "b"), (3001, None, "none")] + rows[5:9] * 2
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rows = mixed_rows(seed)
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, source string, shard string, words string, size string")
    recipe = mixing.Recipe(shard_words=2_000, shard_blocks=8)
    got = mixing.shares(mixing.sized(docs), recipe).toPandas()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = plain_targets(sizes)
    got["taken"] = [sum(p["words"] for p in parts) for parts in got.parts]
    assert (got.taken <= 2 * got["size"]).all()
    assert all(0 < p["words"] <= n for n, parts in zip(got["size"], got.parts) for p in parts)
    assert Counter(got["size"].tolist()) == Counter(len((t or "").split()) for _, t, _ in rows)
    mixed = mixing.mix(docs, recipe).toPandas()
    taken = mixed.assign(source=mixed.source.fillna("NULL")).groupby("source").words.sum().to_dict()
    for source, target in want.items():
        assert abs(taken.get("NULL" if source is None else source, 0) - target) <= 0.5 + 1e-6, source
    assert sorted(mixed.columns) == sorted(["doc_id", "text", "source", "_shard", "_words", "size", "shard", "place", "epoch", "words"])
    assert set(np.round(got.target, 4)) == set(np.round(list(want.values()), 4))
    for _, shard in mixed.groupby("shard"):
        assert sorted(shard.place) == list(range(len(shard)))
    again = mixing.mix(docs, recipe).toPandas()
    a, b = (Counter(map(str, x[["doc_id", "shard", "place", "epoch", "words"]].to_numpy().tolist())) for x in (mixed, again))
    assert a == b


def test_the_tree_splits_quotas_exactly(spark):
    root = spark.createDataFrame([([1_000_003, 17, 0, 4_500],)], "quotas array<bigint>")
    leaves = mixing.split(root, 5, 9).orderBy("shard").collect()
    quotas = np.array([r["quotas"] for r in leaves])
    assert [r["shard"] for r in leaves] == list(range(32)) and quotas.min() >= 0
    assert quotas.sum(0).tolist() == [1_000_003, 17, 0, 4_500]
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 1
    assert np.array([r["starts"] for r in leaves]).tolist() == (np.cumsum(quotas, 0) - quotas).tolist()


def test_draws_of_the_hypergeometric(spark):
    from math import comb

    from pyspark.sql import functions as F

    n, k, d, times = 30, 11, 13, 20_000
    u = (F.col("id") + 0.5) / times
    whole = lambda x: F.lit(x).cast("long")
    got = Counter(r[0] for r in spark.range(times).select(mixing.hypergeometric(whole(n), whole(k), whole(d), u)).collect())
    for x in range(0, 12):
        assert abs(got[x] / times - comb(k, x) * comb(n - k, d - x) / comb(n, d)) < 1.5 / times * 2
    forced = spark.range(5).select(mixing.hypergeometric(whole(7), F.col("id"), whole(7), F.lit(0.999)), mixing.hypergeometric(F.col("id"), F.col("id"), whole(0), F.lit(0.2)))
    assert [tuple(r) for r in forced.collect()] == [(i, 0) for i in range(5)]


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.shares(mixing.sized(none)).count() == mixing.mix(none).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["parts"]) for r in mixing.shares(mixing.sized(bare)).collect()] == [(0, 0.0, [])] * 2
    assert mixing.mix(bare).count() == 0


def test_mixing_starts_no_python(spark):
    sizes = mixing.sized(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and sizes.count() > 0
