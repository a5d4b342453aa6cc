"""Near-duplicates by SimHash fingerprints, found with Golay fuzzy keys.

A fingerprint of 64 bits is three segments of at most 23 bits.  The binary Golay code has 4,096
codewords of 23 bits, and every word lies within 3 bits of exactly one of them: its codeword.
`near(v)` are the codewords within 4 bits of v, one to six of them.  Two facts give the keys:

  u, v at most 1 bit apart: the codeword of u is in near(v).
  u, v at most 2 bits apart: near(u) and near(v) meet (at the codeword of a word between them).

With at most 4 errors in three segments, either one segment has none and another at most 2, or two
have at most 1 each and the third at most 2.  Keys of the first kind are a whole segment and a near
codeword of another.  Keys of the second kind pair two segments, (codeword of one, a near codeword
of the other) both ways, and add one of three parts of the third segment, of which its 2 errors
leave one whole.  So every pair within 4 bits shares a key, and by chance two fingerprints share a
given key once in 2^31 or more; each shared key is verified by counting bits.

Copies first become one fingerprint.  Then nobody compares all members of a key: each is held
against the smallest and the largest fingerprint of its key (for keys of two that is all there is),
the links found are contracted to components, and only keys that still hold several components
compare the members outside the largest of these with the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.components import components
from traceloom.session import pin

RADIUS, SHINGLE, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
CHUNK = 1 << 18
#: Crowded keys up to which their table (24 bytes each) is broadcast.
BROADCAST = 1_000_000


def fingerprint(text: str | None) -> int:
    """SimHash of a text as a signed 64-bit integer; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(SHINGLE, len(words))
    number = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, number, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, number)].tolist(), ends[at + width - 1 : at + CHUNK + width - 1].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > number, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) per row: fp is a long.  Null and empty texts, and those without words, have fp 0."""
    source = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id, source.schema[id].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id, "fp"])

    return source.mapInArrow(run, schema)


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and per remainder its errors of weight up to 4."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)], np.int64)
    high = np.array([remainder(v << 12) for v in range(1 << 11)], np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            errors[int(low[e & 0xFFF] ^ high[e >> 12])].append(e)  # the lightest comes first
    table = np.full((1 << 11, 6), -1, np.int64)
    for s, e in enumerate(errors):
        table[s, : len(e)] = e
    return low, high, table


def near(words: np.ndarray) -> np.ndarray:
    """Per word the indices of the codewords within 4 bits, its own codeword first; -1 fills up to six."""
    low, high, table = _golay()
    errors = table[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of some fingerprints: (row, key)."""
    bits = fps.astype(np.int64).view(np.uint64)
    words = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    close = [near(w) for w in words]
    rows, found = [], []

    def add(tag: int, left: np.ndarray, right: np.ndarray, rest: np.ndarray | int = 0) -> None:
        row, column = np.nonzero((left >= 0) & (right >= 0) & np.ones((1, 6), bool))
        wide = lambda x: np.broadcast_to(x, (len(fps), 6))[row, column]
        rows.append(row)
        found.append((tag << 50) | (wide(left) << 24) | wide(right) | wide(rest) << 12)

    tag = 0
    for a, b in permutations(range(3), 2):
        add(tag := tag + 1, words[a][:, None], close[b])
    for c, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
        for part in np.array_split(np.arange(SEGMENTS[c][1]), 3):
            rest = ((words[c] >> part[0]) & ((1 << len(part)) - 1))[:, None]
            add(tag := tag + 1, close[a][:, :1], close[b], rest)
            # its own codewords came above
            add(tag, np.where(np.arange(6) == 0, -1, close[a]), close[b][:, :1], rest)
    return np.concatenate(rows), np.concatenate(found)


def _keyed(fps: DataFrame) -> DataFrame:
    """A row per fingerprint and key; the other columns come along."""
    schema = T.StructType([T.StructField("key", T.LongType()), *fps.schema.fields])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, found = keys(batch.column(0).to_numpy())
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(found), *taken.columns], names=schema.names)

    return fps.mapInArrow(run, schema)


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def linked(fps: DataFrame) -> DataFrame:
    """(fp, component) for every fingerprint that has a link, from a table of distinct `fp`."""
    # stored fingerprints are few files, their keys are many rows: as many tasks as any shuffle has
    many = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _keyed(fps.select("fp").repartition(many, "fp"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    shared = pin(shared.where("n > 1"))
    # most shared keys have two members, and those are at hand
    ends = shared.where(_close("low", "high")).select(F.col("low").alias("a"), F.col("high").alias("b"))
    crowded = shared.where("n > 2").select("key", "low", "high")
    if crowded.count() <= BROADCAST:
        crowded = F.broadcast(crowded)
    held = pin(members.join(crowded, "key"))
    to_low = held.where(_close("fp", "low")).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    to_high = held.where(_close("fp", "high")).select(F.col("fp").alias("a"), F.col("high").alias("b"))
    first = pin(components(ends.unionAll(to_low).unionAll(to_high).where("a <> b")))

    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    known = pin(first.join(sizes, "component").select(F.col("node").alias("fp"), "component", "n"))
    named = held.select("key", "fp").join(known, "fp", "left")
    named = named.select("key", "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("n", F.lit(1)).alias("n"))
    mixed = named.groupBy("key").agg(
        F.min("component").alias("least"),
        F.max("component").alias("most"),
        F.max(F.struct("n", "component"))["component"].alias("main"),
    )
    mixed = pin(mixed.where("least < most").select("key", "main"))
    within = pin(named.join(mixed, "key").select("key", "fp", "component", "main"))
    outside = within.where("component <> main").select("key", F.col("fp").alias("fp2"), F.col("component").alias("b"))
    more = within.join(outside, "key").where((F.col("component") != F.col("b")) & _close("fp", "fp2"))
    second = pin(components(more.select(F.col("component").alias("a"), "b").distinct()))
    moved = second.select(F.col("node").alias("component"), F.col("component").alias("to"))
    final = first.join(moved, "component", "left").select(F.col("node").alias("fp"), F.coalesce("to", "component").alias("component"))
    alone = second.join(first, "node", "left_anti").select(F.col("node").alias("fp"), "component")
    return final.unionByName(alone)


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, fp) per row of docs, and per fingerprint (fp, component, component_id, winner).

    component is a fingerprint of the group, component_id the smallest id in it and winner the
    fingerprint of a row with that id, the smallest if there are several.
    """
    marked = pin(fingerprints(docs.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{text}`").alias("text")), "doc", "text"))
    per = pin(marked.groupBy("fp").agg(F.min("doc").alias("least")))
    groups = pin(linked(per))
    labelled = per.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min(F.when(F.col("least").isNotNull(), F.struct("least", "fp"))).alias("x"))
    least = least.select("component", F.col("x.least").alias("component_id"), F.col("x.fp").alias("winner"))
    return marked, pin(labelled.join(pin(least), "component").select("fp", "component", "component_id", "winner"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links between fingerprints of at most 4 differing
    bits, the row's own included.  Rows without words share fingerprint 0.  Null ids take part and
    get the smallest id of their component, null if there is none.  Other columns are ignored.
    """
    marked, groups = grouped(docs, id, text)
    rows = marked.join(groups.select("fp", "component_id"), "fp", "left")
    return rows.select(F.col("doc").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, with all columns, of every group of near-duplicates: one with the group's smallest id.

    Of several rows with that id in one group the smallest stays, by the text and then all columns in
    order; rows that share an id but lie in different groups are kept each.  Rows with a null id are
    not judged and stay.
    """
    named = docs.where(F.col(f"`{id}`").isNotNull())
    marked, groups = grouped(named, id, text)
    winners = groups.where("fp = winner").select(F.col("component_id").alias("doc"), "fp").distinct()
    times = marked.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    kept = pin(winners.join(times, "doc"))
    # nearly all ids have one row, and that is the winner
    # one plan at every size: the documents are shuffled by their ids once, and so are the ids kept
    once = kept.where("n = 1").select(F.col("doc").alias(id)).hint("merge")
    stay = named.join(once, id, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    # where an id repeats, the rows are told apart by their fingerprints
    again = pin(kept.where("n > 1").select("doc", "fp"))
    row = F.struct(F.col(f"`{text}`").alias("_body"), F.struct("*").alias("_row")).alias("row")
    repeated = named.join(again.select(F.col("doc").alias(id)).distinct(), id, "left_semi").select(F.col(f"`{id}`").alias("doc"), row)
    repeated = fingerprints(repeated.select(F.struct("doc", "row").alias("all"), F.col("row._body").alias("text")), "all", "text")
    repeated = repeated.select("all.doc", "all.row", "fp").join(again, ["doc", "fp"]).groupBy("doc", "fp").agg(F.min("row").alias("row"))
    return stay.unionByName(repeated.select("row._row.*")).unionByName(docs.where(F.col(f"`{id}`").isNull()))
