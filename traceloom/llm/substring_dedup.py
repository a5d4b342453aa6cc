"""Repeated passages across documents, by seed and extend.

Seeds.  Every window of `window` words holds an anchor: the word n-gram with the smallest hash in
it (winnowing).  Consecutive windows with the same anchor form a segment, so every window belongs
to one segment and equal windows have equal anchors.  Documents are joined on their anchors: only
anchors that two documents hold go on.

Extend.  A segment is its anchor extended both ways as far as it stays the anchor.  Segments of
equal words are one class, and a class needs only its smallest document: in all later documents the
whole segment is a repeat.  Only the first document of a class looks at single windows, and only
where the same anchor has other surroundings elsewhere: it finds how far the match with an earlier
document reaches to either side.  Windows found that way, next to each other, make up the maximal
repeats, which are returned as spans.

Classes and windows keep the smallest and largest id of their documents, sums that are combined
before every shuffle; a passage in a third of all documents is a hot key of joins only, whose large
partitions can be split.  Segments are stored once; texts are read again instead of shuffling their windows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.session import pin

WINDOW, GRAM = 13, 4
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return up(_BASE), up(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Passages:
    """The segments of one text: `start` (first window), `windows`, `anchor`, `content`; hash of a window: `window(i)`."""

    def __init__(self, words: list[bytes], window: int = WINDOW) -> None:
        import xxhash

        n = len(words)
        self.start = self.windows = self.anchor = self.content = np.zeros(0, np.int64)
        if n < window:
            return
        gram = min(GRAM, window)
        up, down = _powers(1 << max(12, n.bit_length()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
        self._hash = lambda a, b: _mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = np.arange(n - gram + 1)
        grams = self._hash(at, at + gram)
        # the leftmost smallest n-gram of every window
        chosen = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1) + np.arange(n - window + 1)
        self.start = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        self.windows = np.diff(np.concatenate([self.start, [len(chosen)]]))
        self.anchor = grams[chosen[self.start]].view(np.int64)
        self.content = self._hash(self.start, self.start + self.windows + window - 1).view(np.int64)
        self._size = window

    def window(self, at: np.ndarray) -> np.ndarray:
        return self._hash(at, at + self._size).view(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at ASCII white space only


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """A row (anchor, content, doc) per different segment of a document."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), docs.schema["doc"]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [Passages(words_of(t.as_py()), window) for t in batch.column(1)]
            rows = np.repeat(np.arange(len(found)), [len(p.start) for p in found])
            columns = [pa.array(np.concatenate([getattr(p, n) for p in found]) if found else [], pa.int64()) for n in ("anchor", "content")]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(pa.array(rows, pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _pair(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number for an anchor and a content, which are hashes themselves."""
    return anchor.view(np.uint64) * np.uint64(_BASE) ^ content.view(np.uint64)


def _pairs(column) -> list[np.ndarray]:
    """The (anchor, content) pairs of every row of an Arrow list column, each as one number; null lists are empty."""
    ends = np.asarray(column.offsets)
    values = column.values
    pairs = _pair(values.field(0).to_numpy(zero_copy_only=False), values.field(1).to_numpy(zero_copy_only=False))
    return [pairs[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """A row (anchor, content, doc) per window of the segments in `parts`; content is the window's."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), docs.schema["doc"]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, anchors, hashes = [], [], []
            for row, (text, wanted) in enumerate(zip(batch.column(1), _pairs(batch.column(2)))):
                p = Passages(words_of(text.as_py()), window)
                take = np.isin(_pair(p.anchor, p.content), wanted)
                if take.any():
                    many = p.windows[take]
                    at = np.concatenate([np.arange(s, s + n) for s, n in zip(p.start[take], many)])
                    anchors.append(np.repeat(p.anchor[take], many))
                    hashes.append(p.window(at))
                    rows += [row] * len(at)
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([join(anchors), join(hashes), ids], names=schema.names)

    return docs.mapInArrow(run, schema)


def _per_document(rows: DataFrame, name: str) -> DataFrame:
    # at most as many as the document has windows
    return rows.groupBy("doc").agg(F.collect_set(F.struct(F.col("anchor").alias("a"), F.col("content").alias("b"))).alias(name))


def repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What repeats an earlier document, per document id: whole segments, and single windows."""
    source = docs.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("_text")).where("doc is not null")
    segments = pin(_segments(source, window))
    anchors = segments.groupBy("anchor").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("content") < F.max("content")).alias("varies")
    )
    anchors = pin(anchors.where("low < high").select("anchor", "varies"))
    shared = pin(segments.join(anchors, "anchor"))
    classes = pin(shared.groupBy("anchor", "content").agg(F.min("doc").alias("first")))
    known = shared.join(classes, ["anchor", "content"])
    whole = pin(_per_document(known.where("doc > first"), "whole"))

    first = pin(_per_document(known.where("doc = first and varies"), "parts"))
    single = pin(_windows(source.join(first, "doc"), window).distinct())
    met = pin(single.groupBy("anchor", "content").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"))
    return whole, pin(_per_document(single.join(met, ["anchor", "content"]).where("doc > first"), "single"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, spans and kept_text.

    A word goes if a window of `window` words over it also starts in a document with a smaller id.
    Spans are maximal runs (start, end) of such words, end exclusive; kept_text is the other words
    joined by one space.  Windows are judged on the input.  Null texts have no words.  Rows with a
    null id are neither sources nor cut; rows that repeat an id are one document to each other.
    Other columns are ignored.
    """
    whole, single = repeats(docs, window, id, text)
    source = docs.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("_text"))
    joined = source.join(whole, "doc", "left").join(single, "doc", "left").select("doc", "_text", "whole", "single")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([T.StructField(id, source.schema["doc"].dataType), *fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column(1), _pairs(batch.column(2)), _pairs(batch.column(3)))
            out = [_cut(words_of(text.as_py()), whole, single, window) for text, whole, single in rows]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def _cut(words: list[bytes], whole: np.ndarray, single: np.ndarray, window: int) -> tuple:
    if not len(whole) and not len(single):
        return len(words), 0, [], b" ".join(words).decode()
    p = Passages(words, window)
    gone = np.zeros(len(words) + 1, np.int64)
    hit = np.isin(_pair(p.anchor, p.content), whole)
    np.add.at(gone, p.start[hit], 1)
    np.add.at(gone, p.start[hit] + p.windows[hit] + window - 1, -1)
    if len(single):
        at = np.arange(int(p.windows.sum()))
        at = at[np.isin(_pair(np.repeat(p.anchor, p.windows), p.window(at)), single) & ~np.repeat(hit, p.windows)]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
    covered = np.cumsum(gone)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]))).tolist()
    spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
    kept = b" ".join([w for w, g in zip(words, covered.tolist()) if not g]).decode()
    return len(words), int(covered.sum()), spans, kept
