"""Benchmark decontamination with SimHash windows of the size of the items.

Words are runs of letters and digits, in lower case; shingles are five words, or all words of an item
that has fewer.  A document's windows are as long as the item (or the document, if that is shorter).
Similarity is the exact weighted one of the shingles: sum of smaller over sum of larger counts.

Only shingles that an item holds leave the scan (`hits`).  A window of similarity 0.8 shares four
fifths of the item's shingles, so it shares one of any fifth and one more: a document meets the items
of a length only over that many of their rarest shingles, which loses nothing.  Its windows of that
length start where a hit stands or at its last possible start: a window slid on to its first hit
loses none.

A window's fingerprint is the 64-bit SimHash of its hits, an item's that of its shingles.  Two that
are within RADIUS bits agree in one of RADIUS + 1 blocks of bits, so windows and items of a length
join on (block, bits) and no pair within the radius is missed; the bits that differ are then
counted, and the exact similarity decides.  At similarity 0.8 some 10 bits differ, with a standard
deviation of 3; the radius leaves room for three and a half of these.

Everything is DataFrame functions.  Items come in blocks whose shingles and blocks of bits are few
enough to be broadcast; the documents meet a block in the stage that reads them, so neither texts nor
their other shingles are shuffled.  Nothing else is broadcast: what stems from documents takes many
times the memory of its files, by which Spark chooses, and so is joined by merging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.session import pin

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ.
RADIUS = 20
#: Cuts of the 64 bits into RADIUS + 1 blocks.
_CUTS = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
#: Most shingles, or blocks of bits, of items in one broadcast table (some 100 bytes each).
BLOCK = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(hashes: str, width: int) -> Column:
    """Hashes of all shingles of an array of word hashes; none if it is shorter."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(width))
    return F.expr(
        f"if(size({hashes}) >= {width}, transform(sequence(0, size({hashes}) - {width}), i -> xxhash64({width}, {parts})),"
        " cast(array() as array<bigint>))"
    )


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document id and item that meet: id, item, similarity, start, n_words.

    The similarity is the best over all windows, at least 0.8, rounded to 6 digits; n_words is the
    item's length.  start is the first word of the last best window.  A document shorter than the
    item is one window.  Items without words meet nothing, and so do null and empty texts.  Null ids
    are ids like others; rows that repeat an id give one row.  Other columns are ignored.
    """
    prepared = items.select(
        F.col(f"`{item}`").alias("item"), F.transform(words(F.col(f"`{item_text}`").cast("string")), lambda w: F.xxhash64(w)).alias("hashes")
    ).distinct()
    prepared = prepared.withColumn("m", F.size("hashes")).where("m > 0").withColumn("width", F.least("m", F.lit(SHINGLE)))
    of_width = F.coalesce(*[F.when(F.col("width") == w, _shingles("hashes", w)) for w in range(1, SHINGLE + 1)])
    prepared = prepared.select("item", "m", "width", of_width.alias("shingles"))
    prepared = pin(prepared.withColumn("no", F.monotonically_increasing_id()))
    number = prepared.agg(F.greatest(F.sum("m"), (RADIUS + 1) * F.count(F.lit(1)))).first()[0]
    widths = sorted(r[0] for r in prepared.select("width").distinct().collect())  # five at most
    parts = -(-number // BLOCK) or 1

    hashed = docs.select(
        F.col(f"`{id}`").alias("doc"), F.transform(words(F.col(f"`{text}`").cast("string")), lambda w: F.xxhash64(w)).alias("hashes")
    )
    # rows that repeat an id stay apart; null ids are equal inside a struct
    key = F.struct("doc", F.xxhash64("hashes").alias("row"), F.size("hashes").alias("n"))
    hashed = [hashed.select(key.alias("key"), F.lit(w).alias("width"), _shingles("hashes", w).alias("shingles")) for w in widths or [SHINGLE]]
    # items that share an id need not share a block
    found = (_meet(hashed, prepared.where(F.pmod(F.xxhash64("item", "shingles"), F.lit(parts)) == n)) for n in range(parts))
    # blocks are stored one by one: a plan of them all would hold all that they broadcast
    found = [pin(block) if parts > 1 else block for block in found]
    best = reduce(DataFrame.unionAll, found).groupBy("doc", "item", "m").agg(F.max("best").alias("best"))
    return best.select(
        F.col("doc").alias(id),
        F.col("item").alias(item),
        F.round("best.similarity", 6).alias("similarity"),
        F.col("best.start").cast("long").alias("start"),
        F.col("m").cast("long").alias("n_words"),
    )


def _seeds(items: DataFrame) -> DataFrame:
    """Per item and shingle its count, and if it is one of the rarest, of which every window similar enough holds one."""
    per = items.select("no", "m", "width", F.explode("shingles").alias("shingle")).groupBy("no", "m", "width", "shingle").agg(F.count(F.lit(1)).alias("held"))
    per = per.withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    rarer = F.sum("held").over(Window.partitionBy("no").orderBy("holders", "shingle").rowsBetween(Window.unboundedPreceding, -1))
    number = F.col("m") - F.col("width") + 1
    spare = number - F.ceil(F.round(number * SIMILARITY, 6))  # as many may be missing
    return per.select("no", "m", "width", "shingle", "held", (F.coalesce(rarer, F.lit(0)) <= spare).alias("probe"))


def _fingerprint(rows: DataFrame, *key: str) -> DataFrame:
    """Per key the number of its shingles and their SimHash: a bit is 1 if it is set in over half of them."""
    # two counters of 32 bits in a long
    pair = lambda b: F.sum(F.shiftrightunsigned("shingle", b).bitwiseAND(F.lit(0x0000000100000001))).alias(f"c{b}")
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hits"), *[pair(b) for b in range(32)])
    low = lambda b: F.col(f"c{b}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda b: F.shiftrightunsigned(f"c{b}", 32)
    ones = [(b, low(b)) for b in range(32)] + [(b + 32, high(b)) for b in range(32)]
    bits = [F.when(2 * count > F.col("n_hits"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for b, count in ones]
    return sums.select(*key, "n_hits", reduce(Column.bitwiseOR, bits).alias("fp"))


def _blocks() -> Column:
    """An array of (block, bits) of a fingerprint."""
    cut = lambda a, b: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(_CUTS, _CUTS[1:]))])


def _inside(windows: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits of windows (key, m, width, start): both are laid in stretches of m words, so a window meets two of them."""
    stretch = F.explode(F.expr("array(start div m, start div m + 1)")).alias("stretch")
    laid = hits.withColumn("stretch", F.expr("p div m"))
    meet = windows.select("*", stretch).join(laid.hint("merge"), ["key", "m", "width", "stretch"])
    return meet.where("p >= start and p <= start + least(key.n, m) - width").drop("stretch")


def _meet(hashed: list[DataFrame], items: DataFrame) -> DataFrame:
    """(doc, item, m, best): best is (similarity, start)."""
    seeds = pin(_seeds(items))
    # outer: else a filter on the size of the array would be moved below and compute it anew per word
    at = reduce(DataFrame.unionAll, [h.select("key", "width", F.posexplode_outer("shingles").alias("p", "shingle")) for h in hashed])
    # BLOCK bounds the broadcast side; only the hits leave this stage
    hits = pin(at.join(F.broadcast(seeds.select("shingle").distinct()), "shingle", "left_semi"))
    lengths = seeds.where("probe").select("shingle", "m").distinct()
    met = hits.join(F.broadcast(lengths), "shingle").select("key", "m", "width").distinct()
    placed = pin(hits.join(met.hint("merge"), ["key", "width"]).select("key", "m", "width", "p", "shingle"))
    windows = placed.select("key", "m", "width", F.expr("least(p, greatest(0, key.n - m))").alias("start")).distinct()
    marked = _fingerprint(_inside(windows, placed), "key", "m", "width", "start")
    # as many shingles have to be common
    size, own = "(least(key.n, m) - width + 1)", "(m - width + 1)"
    marked = pin(marked.where(F.expr(f"n_hits * {1 + SIMILARITY} >= {SIMILARITY} * ({size} + {own}) - 1e-9")))

    shingles = items.select("no", "m", "width", F.explode("shingles").alias("shingle"))
    item_marks = _fingerprint(shingles, "no", "m", "width").select("no", "m", F.col("fp").alias("item_fp"), F.inline(_blocks()))
    near = marked.select("key", "m", "width", "start", "fp", F.inline(_blocks())).join(F.broadcast(pin(item_marks)), ["m", "block", "bits"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = pin(near.select("key", "m", "width", "start", "no").distinct())

    inside = _inside(near.select("key", "m", "width", "start").distinct(), placed)
    counts = inside.groupBy("key", "m", "width", "start", "shingle").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(near.hint("merge"), ["key", "m", "width", "start"]).join(F.broadcast(seeds.select("no", "shingle", "held")), ["no", "shingle"])
    common = both.groupBy("key", "no", "m", "width", "start").agg(F.sum(F.least("n", "held")).alias("common"))
    scored = common.withColumn("similarity", F.expr(f"common / ({size} + {own} - common)")).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("key", "no", "m").agg(F.max(F.struct("similarity", "start")).alias("best"))
    return best.join(F.broadcast(items.select("no", "item")), "no").select("key.doc", "item", "m", "best")


def remove_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all columns, that meet no item; rows with a null id are judged by their text, too."""
    found = leaks(docs.where(F.col(f"`{id}`").isNotNull()), items, id, text, item, item_text)
    clean = docs.where(F.col(f"`{id}`").isNotNull()).join(pin(found.select(id).distinct()), id, "left_anti")
    nameless = docs.where(F.col(f"`{id}`").isNull())
    if nameless.isEmpty():
        return clean
    # without an id the text itself is the key
    dirty = leaks(nameless, items, text, text, item, item_text).select(text).distinct()
    kept = nameless.join(dirty, nameless[text].eqNullSafe(dirty[text]), "left_anti")
    return clean.unionByName(kept)
