"""Toxicity as an ordinal regression with cumulative links over sparse text features.

Grades: 0 for documents labelled clean; a document labelled toxic has grade 1, or 2 if it repeats
markers more often than the median toxic document.  Markers are the words that the labels tie to
toxicity.  One weight vector serves all thresholds t_0 < t_1: P(grade > k) = sigmoid(w x - t_k).
The output is the expected grade and the probability of any.

A document copied many times would make all its words look telling.  So words are weighed by the
different words that follow them, which copies share: a feature's scale grows with the contrast of
its contexts between the labels and with their number, and the ridge holds weak features down.

Counts of words and contexts cover all labelled rows.  The model itself is fitted on at most `fit_rows`
labelled rows, those with the smallest hash of their id, so that it fits one process.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.session import pin

WORD = re.compile(r"[^\W\d_]+")
#: Words with the strongest contrast in documents, and of those the features, strongest in contexts.
CANDIDATES, FEATURES = 6_000, 1_500
#: Contexts that a feature needs, and from how many on it has its full scale.
CONTEXTS, FULL = 5, 60
FIT_ROWS = 20_000
#: Labels up to which they are broadcast (some 16 bytes each) and the texts stay where they are.
BROADCAST = 2_000_000
#: Log odds from which a word counts as a marker.
MARKER = 2.0
RIDGE, STEPS = 5e-4, 400


def words(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


@dataclass(frozen=True)
class Ordinal:
    """Shared weights and ascending thresholds over an index of words."""

    index: dict[str, int]
    #: already times the features' scales
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, counts: Counter) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        z = sum(self.weights[self.index[w]] * np.log1p(n) for w, n in counts.items() if w in self.index)
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -50, 50)))


def _tallied(labelled: DataFrame) -> DataFrame:
    """(word, label, docs): labelled rows of each label that hold the word, added up per batch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            per: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(1), batch.column(2).to_pylist()):
                per[label].update(words(text.as_py()).keys())
            for label, count in per.items():
                rows = [list(count), [label] * len(count), list(count.values())]
                kinds = [pa.string(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=["word", "label", "docs"])

    return labelled.mapInArrow(run, "word string, label int, docs long")


def _contexts(labelled: DataFrame, chosen: set[str]) -> DataFrame:
    """(word, label, next): a row per batch for each chosen word and hash of the word after it."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found = set()
            for text, label in zip(batch.column(1), batch.column(2).to_pylist()):
                line = WORD.findall(text.as_py().lower())
                found.update((w, label, after) for w, after in zip(line, [*line[1:], ""]) if w in chosen)
            rows = list(found)
            hashed = [xxhash.xxh64_intdigest(r[2]) - (1 << 63) for r in rows]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(hashed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "next"])

    return labelled.mapInArrow(run, "word string, label int, next long").distinct()


def _vectors(labelled: DataFrame, index: dict[str, int]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted((index[w], n) for w, n in words(t.as_py()).items() if w in index) for t in batch.column(1)]
            lists = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), *lists], names=["label", "at", "n"])

    return labelled.mapInArrow(run, "label int, at array<int>, n array<int>")


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Ordinal | None:
    """From the rows of docs whose id has a label of 0 or 1; None unless both occur.

    Null ids, texts and labels are left out, empty texts are clean or toxic as labelled.
    """
    marks = labels.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label")).where("_label in (0, 1)")
    source = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).where("_text is not null")
    if marks.count() <= BROADCAST:
        labelled = source.join(F.broadcast(marks), "_id").select("_id", "_text", "_label")
    else:  # the texts are shuffled once and read three times
        labelled = pin(source.join(marks, "_id").select("_id", "_text", "_label"))
    sizes = {r["_label"]: r["count"] for r in labelled.select("_label").groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    best = _contrast(_tallied(labelled), "docs", CANDIDATES)
    counts = _contexts(labelled, {r["word"] for r in best}).groupBy("word", "label").agg(F.count(F.lit(1)).alias("n"))
    best = _contrast(pin(counts), "n", FEATURES, CONTEXTS)
    index = {r["word"]: n for n, r in enumerate(best)}
    odds = np.array([r["odds"] for r in best])
    scale = np.abs(odds) / 5 * np.sqrt(np.minimum(1, np.array([r["total"] for r in best]) / FULL))

    threshold = None
    if sizes[0] + sizes[1] > fit_rows:
        part = fit_rows / (sizes[0] + sizes[1])
        threshold = int(part * (1 << 63)) - (1 << 62)
        labelled = labelled.where(F.shiftright(F.xxhash64("_id"), 1) < threshold)
    # copies count once; about fit_rows are left, spread by the hash
    rows = pin(_vectors(labelled, index).distinct()).limit(2 * fit_rows).collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    fitted = _fit(rows, index, odds >= MARKER, scale)
    return Ordinal(index, fitted.weights * scale, fitted.thresholds)


def _contrast(counts: DataFrame, count: str, number: int, least: int = 1) -> list:
    """The words with the strongest log odds between the labels, weighed by how often they were seen."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col(count))), F.lit(0))
    words = counts.groupBy("word").agg(of(1).alias("one"), of(0).alias("zero"), F.sum(count).alias("total"))
    words = pin(words.where(F.col("total") >= least))
    all_one, all_zero = words.agg(F.sum("one"), F.sum("zero")).first()
    share = lambda c, n: (F.col(c) + 0.5) / ((n or 0) + 1)
    odds = words.withColumn("odds", F.log(share("one", all_one) / share("zero", all_zero)))
    return odds.orderBy(F.desc(F.abs("odds") * F.sqrt("total")), "word").limit(number).collect()


def _fit(rows: list, index: dict[str, int], markers: np.ndarray, scale: np.ndarray) -> Ordinal:
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    at = np.array([a for r in rows for a in r["at"]], np.int64)
    n = np.array([x for r in rows for x in r["n"]], np.float64)
    toxic = np.array([r["label"] for r in rows])
    hits = np.bincount(row, n * markers[at], len(rows)) if len(at) else np.zeros(len(rows))
    grade = toxic + ((toxic == 1) & (hits > max(1.0, float(np.median(hits[toxic == 1])))))
    values = np.log1p(n) * scale[at]
    top = int(grade.max())
    # start at the logits of the shares of each grade
    shares = np.clip([(grade > k).mean() for k in range(top)], 1e-4, 1 - 1e-4)
    first, gaps = -np.log(shares[0] / (1 - shares[0])), np.full(top - 1, 0.0)
    weights = np.zeros(len(index))
    state = [np.zeros(len(index) + top) for _ in range(2)]
    for step in range(1, STEPS + 1):
        thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(row, values * weights[at], len(rows)) if len(at) else np.zeros(len(rows))
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - thresholds, -50, 50)))  # P(grade > k)
        padded = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        pick = np.arange(len(rows))
        high, low = padded[pick, grade], padded[pick, grade + 1]
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        likely = np.maximum(high - low, 1e-9)
        pull = (slope_high - slope_low) / likely  # derivative of log likelihood by z
        by_weight = (np.bincount(at, values * pull[row], len(index)) if len(at) else 0) / len(rows) - RIDGE * weights
        by_threshold = np.zeros(top)
        np.add.at(by_threshold, grade[grade > 0] - 1, -(slope_high / likely)[grade > 0])
        np.add.at(by_threshold, grade[grade < top], (slope_low / likely)[grade < top])
        by_threshold /= len(rows)
        by_gap = np.array([by_threshold[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1)])
        up = np.concatenate([by_weight, [by_threshold.sum()], by_gap])
        state[0] = 0.9 * state[0] + 0.1 * up
        state[1] = 0.999 * state[1] + 0.001 * up * up
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        weights, first, gaps = weights + move[: len(index)], first + move[len(index)], gaps + move[len(index) + 1 :]
    return Ordinal(index, weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def score(docs: DataFrame, model: Ordinal | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: id, severity (expected grade), score = P(grade > 0), grade (the likeliest), toxic.

    Null and empty texts get what a text without known words gets; zeros without a model.  toxic
    means score >= 0.5.  Other columns are ignored.
    """
    source = docs.select(F.col(f"`{id}`").alias(id), F.col(f"`{text}`").cast("string").alias("_text"))
    if model is None:
        zero = F.lit(0.0)
        return source.select(id, zero.alias("severity"), zero.alias("score"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    fields = [T.StructField("severity", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    schema = T.StructType([T.StructField(id, source.schema[id].dataType), *fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            above = [model.above(words(t.as_py())) for t in batch.column(1)]
            likely = [int(np.argmax(-np.diff(np.concatenate([[1.0], p, [0.0]])))) for p in above]
            columns = [
                pa.array([float(p.sum()) for p in above], pa.float64()),
                pa.array([float(p[0]) for p in above], pa.float64()),
                pa.array(likely, pa.int32()),
                pa.array([bool(p[0] >= 0.5) for p in above], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
