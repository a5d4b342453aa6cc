"""Prefix trie of conversations from sorted sequences: LCPs, a sparse table and binary searches.

A turn becomes 16 bytes of a digest of its role and text, a conversation the bytes of its turns, and
conversations are range-partitioned into blocks by these bytes and their id: what shares a prefix lies
together.  lcp(i) is the number of turns that a row shares with the row before.  A row brings the
prefixes longer than its lcp; each is a node, and each node finds the rows that start with it on its
own: a sparse table over the lcps answers the minimum of any range, and a binary search by doubling
steps goes left and right while the minimum is no less than the node's depth.  All nodes of a block
are searched at once; there is no stack.

Sums over a subtree are differences of running sums over its rows:

  leaves   rows whose turns are no prefix of the next row's
  savings  sum of (n - 1) * bytes over the nodes of a subtree of depth d = sum over its rows but the
           first of the bytes of the lcp(i) turns shared with the row before, less those of d - 1 turns

A block is also given the row before it and the row after it.  A node that reaches over a block's
border is open: its parts are keyed by a digest of the prefix, and a fold in block order adds them up.
There are no more of these than turns in the blocks' first and last rows.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.fold import fold
from traceloom.functions.ordered import scan
from traceloom.session import Scale, pin

#: Bytes of a turn's digest.
WIDE = 16
#: Conversations in a block, about.
BLOCK = 16_384
#: A rebuilt conversation begins with the first turns of the conversation whose id is the last multiple of this ...
FAMILY = 5
#: ... as many as a hash of its id says, less than this.
HEADS = 9


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns) per conversation: its turns in order as (digest, bytes).

    Turns are ordered by their number, null first, equal ones by role and digest; null roles and texts
    are empty.  Rows that repeat a turn stay.  Rows without a conversation are left out.  A turn takes
    some 40 bytes here, whatever its text; a conversation is one row.
    """
    body = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    said = F.concat(F.length(body(role)).cast("string"), F.lit(":"), body(role), body(text))
    digest = F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, WIDE)
    rows = turns.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), body(role).alias("role"), digest.alias("digest"), F.octet_length(body(text)).cast("long").alias("bytes")
        ).alias("t"),
    )
    rows = rows.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).repartition("family")
    own = rows.groupBy("family", "conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("family", "conv", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """(conv, turns): a conversation's first turns become those of its family's first one.

    h = crc32 of the id in decimal, modulo HEADS; the first h turns of the conversation whose id is
    the last multiple of FAMILY (all if it has fewer, none if there is none) are followed by the
    conversation's own turns after its first h.
    """
    whole = Window.partitionBy("family")
    head = F.max(F.when(F.col("conv") == F.col("family"), F.slice("turns", 1, HEADS - 1))).over(whole)
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    rows = sequences.withColumn("head", head).withColumn("h", h)
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv", F.concat(first, own).alias("turns"))


_PART = (
    "block long, piece long, depth long, open boolean, node binary, parent_piece long, parent_open boolean, parent_node binary,"
    " conv long, parent_conv long, n long, children long, leaves long, saved long, ends string, hash string"
)


def trie(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the sequences (conv, turns): a node and its members.

    conv_id (smallest member), depth, parent_conv_id (null for the root, which has depth 0), n_convs,
    n_children, n_leaves (nodes without children below it, itself included), saved_tokens (sum below
    it, itself included, of members less one times the bytes of the node's last turn) and
    ends_sha256 (SHA-256 of the ids of the members that end here, ascending, joined by commas).
    Sequences without turns are members of the root; without any sequence there is no node.  block is the
    number of conversations in a block, about.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    rows = pin(sequences.select(key.alias("key"), "conv", F.transform("turns", lambda t: t["bytes"]).alias("sizes")))
    number = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-number // block)), "key", "conv")
    # block numbers depend on sampled bounds, so they are fixed once and for all
    ranged = pin(ranged.withColumn("block", F.spark_partition_id().cast("long")))
    parts = pin(_with_neighbours(ranged).groupBy("block").applyInArrow(_nodes_of_block, _PART))

    open_nodes = pin(_joined(parts.where("open")))
    known = open_nodes.select("node", F.col("conv").alias("least"))
    up = open_nodes.join(known.select(F.col("node").alias("parent_node"), F.col("least").alias("parent_conv")), "parent_node", "left")
    closed = parts.where("not open and not parent_open")
    # parents first go to their own pieces of a block, so that no parent gathers all its children
    pieces = parts.where("open").select("block", F.col("piece").alias("parent_piece"), "node").join(known, "node").drop("node")
    below = parts.where("not open and parent_open").drop("parent_conv").join(pieces, ["block", "parent_piece"]).withColumnRenamed("least", "parent_conv")
    columns = ("conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "hash")
    every = up.select(*columns).unionAll(closed.select(*columns)).unionAll(below.select(*columns))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return every.toDF(*names)


def _with_neighbours(ranged: DataFrame) -> DataFrame:
    """The rows of all blocks, and per block the row before it and the row after it."""
    row = F.struct("key", "conv", "sizes")
    ends = pin(ranged.groupBy("block").agg(F.min(row).alias("first"), F.max(row).alias("last")).withColumn("one", F.lit(1)))
    next_to = scan(ends, ["one"], ["block"], Scale.of(ends), previous={"before": F.col("last")}, following={"after": F.col("first")})
    sides = [next_to.where(f"{c} is not null").select(f"{c}.*", "block", F.lit(False).alias("own")) for c in ("before", "after")]
    return ranged.withColumn("own", F.lit(True)).unionByName(sides[0]).unionByName(sides[1])


def _joined(parts: DataFrame) -> DataFrame:
    """The open nodes from their parts, which are taken in the order of the blocks."""

    def step(state, part):
        conv, depth, parent, n, children, leaves, saved, ends = part
        if state is None:
            state = [conv, depth, parent, 0, 0, 0, 0, hashlib.sha256(), False]
        state[0] = min(state[0], conv)
        for at, value in enumerate((n, children, leaves, saved), 3):
            state[at] += value
        if ends:
            state[7].update((("," if state[8] else "") + ends).encode())
            state[8] = True
        return state, None

    def end(state):
        return (state[0], state[1], state[2], *state[3:7], state[7].hexdigest())

    values = ("conv", "depth", "parent_node", "n", "children", "leaves", "saved", "ends")
    out = "conv long, depth long, parent_node binary, n long, children long, leaves long, saved long, hash string"
    return fold(parts, "node", ["block"], values, out, step, end)


class Ranges:
    """A sparse table: row k holds the minima of all ranges of 2^k values."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum from low to high, both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out

    def right(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row up to which all values after `at` are at least the depth."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            room = at + 1 < len(row)
            at += np.where(room & (row[np.where(room, at + 1, 0)] >= depth), 1 << k, 0)
        return at

    def left(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row from which on all values up to `at`, its own included, are at least the depth."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            low = at - (1 << k) + 1
            room = low >= 1  # the value of row 0 belongs to no range
            at -= np.where(room & (row[np.where(room, low, 0)] >= depth), 1 << k, 0)
        return at


def shared_turns(keys: list[bytes]) -> np.ndarray:
    """Turns that each key shares with the key before; 0 for the first."""
    turns = np.array([len(k) // WIDE for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.dtype([("a", "<u8"), ("b", "<u8")]))
    starts = np.cumsum(turns) - turns
    both = np.minimum(turns[1:], turns[:-1])
    at = np.repeat(np.cumsum(both) - both, both)
    within = np.arange(int(both.sum())) - at
    left, right = np.repeat(starts[:-1], both) + within, np.repeat(starts[1:], both) + within
    unlike = np.where((flat["a"][left] == flat["a"][right]) & (flat["b"][left] == flat["b"][right]), np.iinfo(np.int64).max, within)
    out = np.zeros(len(keys), np.int64)
    some = np.flatnonzero(both)
    if len(some):
        out[some + 1] = np.minimum(np.minimum.reduceat(unlike, (np.cumsum(both) - both)[some]), both[some])
    return out


def _nodes_of_block(block):
    """Nodes and parts of nodes of one block, from its rows and its neighbours."""
    import pyarrow as pa

    table = block.combine_chunks()
    number = table["block"][0].as_py()
    rows = sorted(zip(table["key"].to_pylist(), table["conv"].to_pylist(), table["own"].to_pylist(), range(table.num_rows)))
    order = np.array([r[3] for r in rows])
    keys, own = [r[0] for r in rows], np.array([r[2] for r in rows])
    lcp = shared_turns(keys)
    before, after = not own[0], not own[-1]
    next_lcp = lcp[-1] if after else -1
    low, high = int(before), len(rows) - int(after)
    lcp, keys, order, convs = lcp[low:high], keys[low:high], order[low:high], np.array([r[1] for r in rows[low:high]], np.int64)
    m = len(keys)
    turns = np.array([len(k) // WIDE for k in keys], np.int64)
    # bytes of the first t turns of row i: upto[first[i] + t]
    sizes = [np.asarray(s, np.int64) for s in table["sizes"].to_pylist()]
    upto = np.concatenate([np.concatenate([[0], np.cumsum(sizes[i])]) for i in order])
    first = np.cumsum(turns + 1) - (turns + 1)

    ranges, smallest = Ranges(lcp), Ranges(convs)
    from_before = np.where(np.arange(m) == 0, lcp if before else -1, lcp)  # what each row really shares with the row before
    leaf = turns > np.append(lcp[1:], next_lcp)
    leaves = np.cumsum(leaf)
    shared = np.cumsum(upto[first + lcp])

    fresh = np.where(np.arange(m) == 0, -1, lcp)  # in this block, prefixes longer than this begin at the row
    many = turns - fresh
    total = int(many.sum())
    row = np.repeat(np.arange(m), many)
    start = np.cumsum(many) - many
    depth = np.arange(total) - start[row] + fresh[row] + 1
    left, right = ranges.left(row, depth), ranges.right(row, depth)
    n = right - left + 1

    def piece(at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The node of depth d that holds row `at`: its first row is found by searching to the left."""
        begin = ranges.left(at, d)
        return start[begin] + d - fresh[begin] - 1

    deep = depth > 0
    parent = np.where(deep, piece(row, np.maximum(depth - 1, 0)), -1)
    begun = depth > from_before[row]  # not a part of a node of the block before
    children = np.bincount(parent[deep & begun], minlength=total)
    least = smallest.least(left, right)
    base = np.where(deep, upto[first[row] + np.maximum(depth - 1, 0)], 0)
    saved = shared[right] - shared[left] - (n - 1) * base + np.where(begun, 0, upto[first[left] + lcp[left]] - base)
    is_open = ((left == 0) & ~begun) | ((right == m - 1) & (depth <= next_lcp))
    held = leaves[right] - leaves[left] + leaf[left]

    # members that end at a node are its first rows, equal and ascending by id
    nothing = hashlib.sha256(b"").hexdigest()
    joined = np.full(total, "", object)
    same = np.flatnonzero(np.append(True, ~((lcp[1:] == turns[1:]) & (turns[1:] == turns[:-1]))))
    for a, b in zip(same, np.append(same[1:], m)):
        joined[piece(np.array([a]), turns[[a]])[0]] = ",".join(map(str, convs[a:b].tolist()))
    hashes = [None if o else hashlib.sha256(e.encode()).hexdigest() if e else nothing for o, e in zip(is_open, joined)]
    names = {}
    for r in sorted({0, m - 1}):
        running = hashlib.sha256()
        names[r, 0] = running.digest()
        for t in range(int(turns[r])):
            running.update(keys[r][t * WIDE : (t + 1) * WIDE])
            names[r, t + 1] = running.digest()

    def name(at: int, d: int) -> bytes | None:
        return names[0 if left[at] == 0 else m - 1, d] if d >= 0 else None

    wanted = np.flatnonzero(is_open)
    node, above = np.full(total, None, object), np.full(total, None, object)
    for at in wanted.tolist():
        node[at], above[at] = name(at, int(depth[at])), name(at, int(depth[at]) - 1)
    parent_open = np.where(deep, is_open[parent], False)
    columns = [
        np.full(total, number), np.arange(total), depth, is_open, node, parent, parent_open, above, least,
        pa.array(np.where(deep, least[parent], 0), mask=~deep), n, children, held, saved,
        np.where(is_open, joined, None), np.array(hashes, object),
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.string()]
    kinds = [pa.field(f.strip().split(" ")[0], k) for f, k in zip(_PART.split(","), kinds)]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=pa.schema(kinds))
