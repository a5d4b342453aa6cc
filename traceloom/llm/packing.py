"""Packing token sequences by bin completion.

A document becomes pieces of at most `limit` tokens.  Which pieces share a sequence depends on
their lengths only, so the packing is solved over the histogram of lengths (at most `limit` rows,
whatever the corpus) and then dealt out to the pieces by their rank within their length.

The solver takes the largest length left, enumerates undominated fillings of the space beside it,
applies each as often as the counts allow, and searches depth first.  A branch ends where the waste
so far leaves no room for a better packing than the best known one; the first of those comes from
best fit decreasing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from traceloom.llm.tokens import encode
from traceloom.session import pin

LIMIT = 1024
#: Nodes of the search, and fillings of a node: bounds of the effort, not of the data.
NODES, FILLINGS = 1_500, 48
#: Pieces of one length are ranked in so many independent parts.
PARTS = 1_024

Pattern = tuple[tuple[int, int], ...]  # (length, how often) in one sequence


def cut(docs: DataFrame, path: str, limit: int = LIMIT, end: int = 2, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32 and, if asked, ids.

    A document is its ids and the end id.  A longer one is cut into pieces of `limit` tokens, of
    which the first may be shorter.  A null or empty text is the end id alone.  Null ids and
    repeated rows are kept, each row for itself; other columns are ignored.
    """
    source = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias("_text"))
    fields = [
        T.StructField(id, source.schema[id].dataType),
        T.StructField("piece", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
        *([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []),
    ]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                tokens = np.append(encode(value.as_py(), path), np.uint32(end)).astype("<u4")
                first = len(tokens) % limit or limit
                borders = [0, *range(min(first, len(tokens)), len(tokens) + 1, limit)]
                for n, (a, b) in enumerate(zip(borders, borders[1:])):
                    rows.append(row)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            out = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: each sequence is filled from 0 without gaps.

    Pieces longer than the limit or without tokens raise an error; no pieces give no rows.
    """
    content = [c for c in ("start", "ids_crc32") if c in pieces.columns]
    key = [c for c in pieces.columns if c not in ("length", *content, "ids")]
    rows = pieces.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(PARTS)))
    counts = rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = pin(counts)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `limit` rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= limit:
        raise ValueError(f"pieces must have 1 to {limit} tokens")
    plan = dealt(pack(histogram, limit))

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy(*key, *content)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")

    spark = pieces.sparkSession
    schema = "length long, _lo long, _hi long, _first long, _each long, _base long"
    # a row per pattern and length in it: bounded by the limit, not by the corpus
    table = F.broadcast(spark.createDataFrame(plan, schema))
    inner = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    return (
        ranked.join(table.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inner)
        .withColumn("sequence_id", F.col("_first") + F.floor(at / F.col("_each")))
        .withColumn("offset", F.col("_base") + (at % F.col("_each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(placed: DataFrame) -> DataFrame:
    """Packed sequences: sequence_id, its ids in order, and how many it has (pieces need `ids`)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `limit` tokens a sequence
    whole = placed.groupBy("sequence_id").agg(parts.alias("_parts"))
    return whole.select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids")).withColumn("n_tokens", F.size("ids"))


def dealt(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, ...]]:
    """Rows (length, lo, hi, first sequence, pieces a sequence, offset): ranks lo to hi of a length go there."""
    out, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        base = 0
        for length, each in pattern:
            lo = used[length]
            used[length] += each * times
            out.append((length, lo, used[length], sequence, each, base))
            base += length * each
        sequence += times
    return out


def pack(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, together exactly the histogram, in few sequences."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    if not counts.any():
        return []
    best = _best_fit(counts.copy(), limit)
    best_bins, floor = sum(n for _, n in best), lower_bound(counts, limit)
    sizes = np.arange(limit + 1)

    # each frame: what is left, its fillings still to try, sequences and patterns so far
    path: list[tuple[Pattern, int]] = []
    stack = [(counts, _fillings(counts, limit), 0)]
    nodes = 0
    while stack and best_bins > floor and nodes < NODES:
        left, options, bins = stack[-1]
        pattern = next(options, None)
        if pattern is None:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes += 1
        times = int(min(left[length] // each for length, each in pattern))
        after = left.copy()
        for length, each in pattern:
            after[length] -= each * times
        rest, bins = int((after * sizes).sum()), bins + times
        if bins + -(-rest // limit) >= best_bins:  # the waste so far rules out a better packing
            continue
        path.append((pattern, times))
        if not rest:
            best, best_bins = path.copy(), bins
            path.pop()
            continue
        stack.append((after, _fillings(after, limit), bins))
    return best


def lower_bound(counts: np.ndarray, limit: int) -> int:
    """Sequences that any packing needs: by volume, and with the large pieces that can't meet."""
    sizes = np.arange(limit + 1)
    best = -(-int((counts * sizes).sum()) // limit)
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    half = limit // 2
    for k in range(0, half + 1):
        # over limit - k: alone with respect to pieces of k and more; over half: one each
        alone = number[limit + 1] - number[limit - k + 1]
        big = number[limit - k + 1] - number[half + 1]
        space = big * limit - (volume[limit - k + 1] - volume[half + 1])
        small = volume[half + 1] - volume[k]
        best = max(best, int(alone + big + max(0, -(-(small - space) // limit))))
    return best


def _best_fit(counts: np.ndarray, limit: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing: beside the largest length always the largest that still fits, in bulk."""
    out = []
    while counts.any():
        pattern, room = Counter(), limit
        while room and (fits := np.flatnonzero(counts[: room + 1])).size:
            length = int(fits[-1])
            each = min(room // length, int(counts[length]))
            pattern[length] += each
            counts[length] -= each
            room -= each * length
        more = min(int(counts[length] // each) for length, each in pattern.items())
        for length, each in pattern.items():
            counts[length] -= more * each
        out.append((tuple(pattern.items()), 1 + more))
    return out


def _fillings(counts: np.ndarray, limit: int) -> Iterator[Pattern]:
    """Undominated ways to fill the sequence of the largest length left, least waste first."""
    largest = int(np.flatnonzero(counts)[-1])
    left = counts.copy()
    left[largest] -= 1
    room = limit - largest
    found = list(dict.fromkeys([*_exact(left, room), *_maximal(left, room)]))[:FILLINGS]
    kept = [f for f in found if not any(g != f and _dominates(g, f) for g in found)] or found
    kept.sort(key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    return iter([tuple(Counter((largest, *f)).items()) for f in kept])


def _exact(left: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """Fillings of one, two or three pieces without waste."""
    if room == 0 or left[room]:
        yield (room,) * bool(room)
        return
    yield from _pairs(left, room, FILLINGS // 3)
    given = 0
    for a in np.flatnonzero(left[:room])[::-1].tolist():
        left[a] -= 1
        for b, c in _pairs(left, room - a, 2):
            if b <= a:
                given += 1
                yield a, b, c
        left[a] += 1
        if given >= FILLINGS // 3:
            return


def _pairs(left: np.ndarray, room: int, most: int) -> list[tuple[int, int]]:
    half = room // 2
    low = np.flatnonzero((left[1 : half + 1] > 0) & (left[room - half : room][::-1] > 0)) + 1
    return [(room - b, b) for b in low.tolist() if 2 * b != room or left[b] > 1][:most]


def _maximal(left: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """Fillings that leave no room for another piece: some first piece, then always the largest that fits."""
    for first in np.flatnonzero(left[: room + 1])[::-1][:FILLINGS].tolist():
        taken, space = [first], room - first
        left[first] -= 1
        while space and (fits := np.flatnonzero(left[: min(space, first) + 1])).size:
            taken.append(int(fits[-1]))
            left[taken[-1]] -= 1
            space -= taken[-1]
        for x in taken:
            left[x] += 1
        yield tuple(taken)
    if not left[: room + 1].any():
        yield ()


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b fit, first into the largest, into places of the sizes of a."""
    places = list(a)
    for x in b:
        at = next((i for i, p in enumerate(places) if p >= x), None)
        if at is None:
            return False
        places[at] -= x
    return len(a) <= len(b)
