"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A mix takes so many words of every source; more than a source has are further epochs of it.  The
documents of a source are dealt into blocks by hash.  A draw is one block in one epoch; the draws of
an epoch follow the epoch's own permutation of the blocks, so the first q draws of a source are a
random choice without repeats inside an epoch.  q, the source's quota, is the fewest draws that hold
its target; the last of them gives only what is missing, down to a part of one document.

The quotas are then split among the output shards by a binary tree: a node with Q draws gives half
of them to its left child, and how many of each source these are is drawn from the multivariate
hypergeometric distribution, source after source.  So shards are of equal size and quotas are met
exactly; what a shard holds is what a shuffle of all draws would have given it, though none was
shuffled.  A shard takes the next draws of each source, and its documents are shuffled inside it.

All random numbers are hashes of the seed and of where they are used, so reruns agree.  Everything is
DataFrame functions; texts are read once and only (id, size) goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.ordered import scan
from traceloom.llm.shared import WORD, fresh
from traceloom.session import Scale, pin

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


@dataclass(frozen=True)
class Recipe:
    """What a mix is to be.

    weights       of the sources in code-point order (null last), repeating
    share         words of the mix as a share of all words
    most          a source gives at most this many times its words
    shard_words   words of one shard of the mix; the number of shards is the next power of two
    least_shards  as many shards at least
    shard_blocks  blocks that a shard is drawn from, so there is one block per shard_words / shard_blocks words
    """

    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    most: int = 2
    shard_words: int = 32_000_000
    least_shards: int = 16
    shard_blocks: int = 32
    seed: int = 13

    def shards(self, words: int) -> int:
        wanted = max(self.least_shards, -(-int(words * self.share) // self.shard_words), 1)
        return 1 << (wanted - 1).bit_length()

    def block_words(self, words: int) -> int:
        return max(1, int(words * self.share) // (self.shards(words) * self.shard_blocks))


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> DataFrame:
    """(id, source, size) per row of docs: size is the number of words, 0 for null texts; with `row`, the whole row, if asked for."""
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD))
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), words.cast("long").alias("size"), *row
    )


def targets(sizes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """(no, source, source_size, target, words) per source, from a table of sizes; words are those of all sources.

    Targets are shares by weight of the words asked for.  Those above the most that a source may give
    stop there, and the excess goes to the others by weight until none is above.  The result is one
    level of words per unit of weight: with sources by how much they hold per unit, the first k of
    them full leave a level for the others that rises while full sources are added and falls after.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))  # one row per source
    no = F.row_number().over(whole.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.array(*[F.lit(float(w)) for w in recipe.weights])
    per = per.withColumn("no", no.cast("long")).withColumn("words", F.sum("source_size").over(whole))
    per = per.withColumn("w", F.get(weights, (F.col("no") % len(recipe.weights)).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(recipe.most)))
    by_need = whole.orderBy(F.col("most") / F.col("w"), "no")
    full = F.coalesce(F.sum("most").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("words") * F.lit(float(recipe.share)) - full) / open_weight)
    target = F.least("most", F.col("w") * F.max("level").over(whole))
    return per.select("no", "source", "source_size", target.alias("target"), "words")


def _uniform(seed: int, *at: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and on where it is used."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *at), 11) * F.lit(2.0**-53)


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, by inversion of u in [0, 1).

    The weights of neighbouring numbers differ by a simple ratio.  Numbers over ten standard
    deviations from the mean (and ten more) have a chance below what a double tells from 0.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")
    mean = k * d / F.greatest(n, F.lit(1.0))
    spread = 10 * F.sqrt(F.greatest(mean * (n - k) * (n - d) / F.greatest(n * (n - 1), F.lit(1.0)), F.lit(0.0))) + 10
    low = F.greatest(F.lit(0).cast("long"), marked + drawn - total, F.floor(mean - spread))
    high = F.least(marked, drawn, F.ceil(mean + spread))
    numbers = F.sequence(low, high)
    # log of the weight of x + 1 less that of x; at the last number of all it is not used
    ratio = lambda x: F.log(F.greatest((k - x) * (d - x), F.lit(1e-300)) / ((x + 1) * F.greatest(n - k - d + x + 1, F.lit(1.0))))
    zero = F.lit(0.0)
    summed = F.aggregate(
        numbers,
        F.struct(zero.alias("log"), zero.alias("sum")),
        lambda a, x: F.struct((a["log"] + ratio(x)).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum")),
        lambda a: a["sum"],
    )

    def step(a: Column, x: Column) -> Column:
        return F.struct(
            (a["log"] + ratio(x)).alias("log"),
            (a["left"] - F.exp(a["log"])).alias("left"),
            F.when(a["left"] > 0, x).otherwise(a["number"]).alias("number"),
        )

    start = F.struct(zero.alias("log"), (u * summed).alias("left"), low.alias("number"))
    return F.aggregate(numbers, start, step, lambda a: a["number"])


def _left(seed: int, level: int) -> Column:
    """What the left child of a node gets of each source: half of all draws."""
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)

    def step(a: Column, s: Column) -> Column:
        quota = F.get("quotas", s)
        own = hypergeometric(a["total"], quota, a["drawn"], _uniform(seed, F.lit(level), "shard", s))
        return _bound(
            own,
            lambda x: F.struct((a["total"] - quota).alias("total"), (a["drawn"] - x).alias("drawn"), F.concat(a["taken"], F.array(x)).alias("taken")),
        )

    start = _bound(
        total,
        lambda t: F.struct(t.alias("total"), F.shiftright(t + 1, 1).alias("drawn"), F.array().cast("array<bigint>").alias("taken")),
    )
    return F.aggregate(F.sequence(F.lit(0), F.size("quotas") - 1), start, step, lambda a: a["taken"])


def split(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """The leaves (shard, starts, quotas) of the tree over one row of `quotas`, an array by source.

    starts are the draws of each source that the shards before take.
    """
    nodes = root.select(
        F.lit(0).cast("long").alias("shard"), F.transform("quotas", lambda q: F.lit(0).cast("long")).alias("starts"), "quotas"
    )
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    for level in range(levels):
        children = _bound(
            _left(seed, level),
            lambda left: F.array(
                F.struct((F.col("shard") * 2).alias("shard"), F.col("starts").alias("starts"), left.alias("quotas")),
                F.struct(
                    (F.col("shard") * 2 + 1).alias("shard"), plus(F.col("starts"), left).alias("starts"), minus(F.col("quotas"), left).alias("quotas")
                ),
            ),
        )
        nodes = nodes.select(F.inline(children))
        if level % 8 == 7:
            nodes = nodes.repartition("shard")
    return nodes


def _dealt(sizes: DataFrame, sources: DataFrame, recipe: Recipe, words: int) -> DataFrame:
    """The rows of sizes with the number, size and target of their source and with their block of it."""
    known = sources.select("no", F.col("source").alias("_source"), "source_size", "target")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / recipe.block_words(words))).cast("long")
    place = F.pmod(F.xxhash64(F.lit(recipe.seed), "id", "size"), blocks)
    rows = sizes.join(known, sizes["source"].eqNullSafe(known["_source"]))
    return rows.select(*[sizes[c] for c in sizes.columns if c != "source"], "source_size", "target", "no", place.alias("block"))


def draws(dealt: DataFrame, sources: DataFrame, recipe: Recipe, words: int) -> DataFrame:
    """The draws of the mix: (no, block, epoch, shard, missing).

    missing is null where the block is taken whole, else the words to take of it.
    """
    held = pin(dealt.groupBy("no", "block").agg(F.sum("size").alias("words")).where("words > 0"))
    wanted = sources.select("no", F.round("target").cast("long").alias("wanted"), "source_size").where("wanted > 0")
    epochs = wanted.withColumn("epoch", F.explode(F.expr("sequence(0, (wanted - 1) div source_size)")))
    epochs = held.join(epochs, "no").withColumn("left", F.col("wanted") - F.col("epoch") * F.col("source_size"))
    epochs = epochs.withColumn("order", F.xxhash64(F.lit(recipe.seed), "no", "epoch", "block")).withColumn("series", F.struct("no", "epoch"))
    running = {"reached": F.col("words")}
    ordered = scan(epochs, ["series"], ["order", "block"], Scale.of(epochs, "series"), position="at", running=running)
    over = F.col("reached") - F.col("left")
    # the draws of a source go on from epoch to epoch
    per = held.groupBy("no").agg(F.count(F.lit(1)).alias("n"))
    chosen = ordered.where(over < F.col("words")).join(per, "no")
    missing = F.when(over > 0, F.col("words") - over).alias("missing")
    chosen = pin(chosen.select("no", "block", "epoch", (F.col("epoch") * F.col("n") + F.col("at")).alias("draw"), missing))

    quotas = sources.select("no").join(chosen.groupBy("no").agg(F.count(F.lit(1)).alias("q")), "no", "left")
    listed = F.sort_array(F.collect_list(F.struct("no", F.coalesce("q", F.lit(0).cast("long")).alias("q"))))
    root = quotas.agg(F.transform(listed, lambda s: s["q"]).alias("quotas")).where("size(quotas) > 0")
    leaves = split(root, recipe.shards(words).bit_length() - 1, recipe.seed)
    spans = leaves.select("shard", F.posexplode(F.arrays_zip("starts", "quotas")).alias("no", "s")).where("s.quotas > 0")
    draw = F.explode(F.expr("sequence(s.starts, s.starts + s.quotas - 1)")).alias("draw")
    spans = spans.select(F.col("no").cast("long").alias("no"), "shard", draw)
    return pin(chosen.join(spans, ["no", "draw"]).select("no", "block", "epoch", "shard", "missing"))


def shares(sizes: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The rows of sizes with source_size and target of their source and parts, what the mix takes of them.

    parts is an array of (epoch, shard, words), empty where nothing is taken.  Rows of size 0 give
    nothing.  Null ids and rows that repeat an id are rows like others, null sources are one source.
    """
    sources = pin(targets(sizes, recipe))
    words = sources.agg(F.max("words")).first()[0] or 0
    dealt = _dealt(sizes, sources, recipe, words)
    drawn = draws(dealt, sources, recipe, words)
    part = F.struct("epoch", "shard", "missing")
    per = drawn.groupBy("no", "block").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.col("missing").isNotNull()).alias("cut"))
    rows = dealt.join(pin(per), ["no", "block"], "left")
    columns = [c for c in dealt.columns if c not in ("no", "block")]
    none = F.array().cast("array<struct<epoch: bigint, shard: bigint, words: bigint>>")
    named = lambda p, words: F.struct(p["epoch"].alias("epoch"), p["shard"].alias("shard"), words.alias("words"))
    whole = rows.where("cut is null or not cut").select(*columns, F.coalesce(F.transform("parts", lambda p: named(p, F.col("size"))), none).alias("parts"))
    # the last block of a source gives documents in the order of their hashes until its target is reached
    order = Window.partitionBy("no").orderBy(F.xxhash64(F.lit(recipe.seed + 1), "id", "size"), "id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = lambda p: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), p["missing"] - F.col("before")))
    last = rows.where("cut").withColumn("before", before)
    last = last.select(*columns, F.transform("parts", lambda p: named(p, F.coalesce(rest(p), F.col("size")))).alias("parts"))
    return whole.unionByName(last).withColumn("parts", F.filter("parts", lambda p: p["words"] > 0))


def mix(docs: DataFrame, recipe: Recipe = Recipe(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, with all columns, once per epoch: shard, place (from 0), epoch and words come on top.

    words is how many of the document's words the mix takes; less than all for at most one document
    of a source.  place is the order inside the shard; shards are of a size that fits a task.  Clashing
    names of docs get a leading underscore.
    """
    rows = shares(sized(docs, id, text, source, whole=True), recipe).select("row", "id", F.explode("parts").alias("p"))
    shuffled = Window.partitionBy("p.shard").orderBy(F.xxhash64(F.lit(recipe.seed + 2), "id", "p.epoch"), "id", "p.words")
    rows = rows.withColumn("place", (F.row_number().over(shuffled) - 1).cast("long"))
    taken = {n.lower() for n in ("shard", "place", "epoch", "words")}
    body = [F.col(f"row.`{c}`").alias(fresh(docs, c) if c.lower() in taken else c) for c in docs.columns]
    return rows.select(*body, "p.shard", "place", "p.epoch", "p.words")
