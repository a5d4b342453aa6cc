"""What filters do in any order, and each filter's fair share, from the game of removals.

A coalition of filters removes the documents that at least one of them fails.  Documents first
shrink to counts per part and failure pattern; the worth v of each of the 32 coalitions, for all
documents, good ones and toxic ones, is a sum of these.  The Hart-Mas-Colell potential follows
recursively: P(empty) = 0 and P(S) = (v(S) + sum of P(S without i)) / |S|.  A filter's Shapley value
is the potential of all filters minus the potential without it.  A step of an order removes the
difference of the worths of two coalitions.

Potentials are kept times 120: with five filters they are whole numbers then, and a share is the sum
over all 120 orders.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.session import pin

#: Letters of the filters by bit; the last one is decided by comparing documents.
FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
#: Orders of the filters: potentials are kept times this.
ORDERS = 120
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that go on with a code point
_SYMBOL = re.compile(rb"[#$%&*|]")


def own_failures(body: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = body.split()  # of bytes: at space, tab, line feed, vertical tab, form feed, carriage return only
    upper = len(body) - len(body.translate(None, _UPPER))
    points = len(body.translate(None, _FOLLOWING))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 3 * points) << 2
        | bool(_SYMBOL.search(body)) << 3
    )


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per row of docs: id, part, mask (bits A to D) and digest, the SHA-256 of the text.

    Null texts are empty, null parts the empty string.  Other columns are ignored.
    """
    source = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"),
    )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            masks, digests = [], []
            for body in batch.column(2):
                body = body.as_py()
                masks.append(own_failures(body))
                digests.append(hashlib.sha256(body).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "digest"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, part string, mask int, digest binary")


def patterns(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failure pattern of all five filters.

    E fails where an equal text has a smaller id anywhere in docs; a null id has no order, so it
    neither fails E nor makes others fail it.  A document is good or toxic if any of its labels says
    so; null and missing labels say neither.  Rows that repeat an id count each.
    """
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = judged(docs, id, text, part).join(said, "id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # one row per id and text: 60 bytes each, whatever the length of the texts
    each = pin(rows.groupBy("id", "part", "mask", "digest", flag("good"), flag("toxic")).agg(F.count(F.lit(1)).alias("n")))
    keys = ["part", "mask", "good", "toxic"]
    every = each.groupBy(*keys).agg(F.sum("n").alias("n"))
    # the first of each group of equal texts; these minima combine before the shuffle, however many copies there are
    named = each.where("id is not null").groupBy("id", "mask", "digest", "good", "toxic")
    named = named.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
    first = named.groupBy("digest").agg(F.min(F.struct("id", "mask", "good", "toxic", "parts")).alias("x"))
    first = first.select("x.mask", "x.good", "x.toxic", F.explode("x.parts").alias("p"))
    first = first.select("p.part", "mask", "good", "toxic", "p.n").unionByName(each.where("id is null").select("part", "mask", "good", "toxic", "n"))
    first = first.groupBy(*keys).agg(F.sum("n").alias("first"))
    # of the documents of a pattern those that are not the first of their text fail E
    both = every.join(first, keys, "left").withColumn("first", F.coalesce("first", F.lit(0)))
    last = 1 << (len(FILTERS) - 1)
    split = F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - F.col("first")).alias("n"))))
    both = both.select("part", "good", "toxic", split.alias("x"))
    count = lambda c: F.sum(F.col("x.n") * F.col(c))
    return both.groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def _worths(counts: DataFrame) -> DataFrame:
    """Per part the sizes and arrays over all coalitions: v, good and toxic documents that a coalition removes."""
    caught = F.filter(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), lambda s: (s.bitwiseAND(F.col("mask")) != 0) | (s == 0))
    # coalition 0 stands for all documents here
    each = counts.select("part", F.explode(caught).alias("s"), "n", "good", "toxic").groupBy("part", "s")
    each = each.agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    held = each.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("n", "good", "toxic")))).alias("held"))
    at = lambda c, s: F.coalesce(F.element_at("held", s)[c], F.lit(0))
    over = lambda c: F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), lambda s: F.when(s == 0, F.lit(0)).otherwise(at(c, s)))
    return held.select("part", at("n", F.lit(0)).alias("size"), over("n").alias("v"), over("good").alias("good"), over("toxic").alias("toxic"))


def _potentials(v: Column) -> Column:
    """The potentials of all coalitions, times ORDERS: a coalition comes after all that lie in it."""
    bits = F.array(*[F.lit(1 << b) for b in range(len(FILTERS))])

    def step(known: Column, s: Column) -> Column:
        inside = F.filter(bits, lambda b: s.bitwiseAND(b) != 0)
        below = F.aggregate(inside, F.lit(0).cast("long"), lambda total, b: total + F.get(known, s - b))
        # as a whole number: the sum is divisible
        value = F.call_function("div", F.get(v, s) * ORDERS + below, F.size(inside).cast("long"))
        return F.concat(known, F.array(value))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), step)


def audit(counts: DataFrame) -> DataFrame:
    """Every step of every order, per part: 600 rows a part, zeros included, from `patterns`.

    kept, removed, redundant (fails the step's filter, but went earlier), unique_fails (fails only
    it), good_lost, toxic_lost, shapley (removed by this filter, summed over all orders).
    """
    worths = pin(_worths(counts))
    shares = worths.withColumn("potential", _potentials(F.col("v")))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = shares.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda letter: F.element_at(F.array(*[F.lit(1 << b) for b in range(len(FILTERS))]), F.call_function("instr", F.lit(FILTERS), letter))
    letters = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: bit(F.substring(F.col("filter_order"), i, F.lit(1))))
    steps = steps.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    steps = steps.withColumn("after", F.aggregate(letters, F.lit(0), lambda a, b: a + b))
    before, all_of = F.col("after") - F.col("own"), F.lit(COALITIONS - 1)
    gain = lambda c: F.get(c, F.col("after")) - F.get(c, before)
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("size") - F.get("v", F.col("after"))).alias("kept"),
        gain("v").alias("removed"),
        (F.get("v", F.col("own")) - gain("v")).alias("redundant"),
        (F.get("v", all_of) - F.get("v", all_of - F.col("own"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", all_of) - F.get("potential", all_of - F.col("own"))).alias("shapley"),
    )
