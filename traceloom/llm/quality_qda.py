"""Document quality by regularised quadratic discriminant analysis.

Statistics of whole texts are transformed to be roughly normal.  Each class is a Gaussian whose
covariance is shrunk towards the pooled one and towards its diagonal.  Training needs only counts,
sums and products per class, one aggregate over all labelled rows; the Cholesky factors of the two
covariances are computed once and shipped with the scoring function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.quality_rules import ledger

#: Shares of the pooled covariance and of the diagonal in a class covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """Transformed statistics over the measurements of the quality ledger."""
    return {
        "length": F.log1p("n_words"),
        "word_size": F.log1p(_per("word_chars", "n_words")),
        "symbols": F.log1p(100 * _per("n_symbols", "n_words")),
        "repeats": F.sqrt(_per("n_repeat_words", "n_words")),
        "same_lines": F.sqrt(_per("n_dup_lines", "n_lines")),
        "upper": F.log1p(100 * _per("n_upper", "word_chars")),
        "line_words": F.log1p(_per("n_words", "n_lines")),
    }


def measure(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the transformed statistics of every row; nulls and empty texts measure zero."""
    book = ledger(docs, id, text)
    return book.select(id, F.array(*[c.cast("double") for c in features().values()]).alias("x"))


@dataclass(frozen=True)
class Discriminant:
    means: tuple[np.ndarray, np.ndarray]
    #: inverse Cholesky factors of the class covariances, and their log determinants with the log prior
    factors: tuple[np.ndarray, np.ndarray]
    offsets: tuple[float, float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        each = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            each.append(offset - 0.5 * np.square((x - mean) @ factor.T).sum(1))
        return each[1] - each[0]


def train(examples: DataFrame) -> Discriminant | None:
    """From rows (x, label 0 or 1).  None if a class has no row; rows with a null label are left out."""
    d = len(features())
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.element_at("x", i + 1) for i in range(d)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i, j in pairs]
    rows = examples.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)), *sums).collect()  # two rows
    found = {r[0]: (r[1], np.array(r[2 : 2 + d]), np.array(r[2 + d :])) for r in rows}
    if len(found) < 2:
        return None
    means, scatters, counts = {}, {}, {}
    for label, (n, total, products) in found.items():
        second = np.zeros((d, d))
        for (i, j), value in zip(pairs, products):
            second[i, j] = second[j, i] = value / n
        means[label], counts[label] = total / n, n
        scatters[label] = second - np.outer(means[label], means[label])
    n = counts[0] + counts[1]
    pooled = (counts[0] * scatters[0] + counts[1] * scatters[1]) / n
    # a floor for statistics that never vary in a class
    floor = 1e-3 * np.diag(np.maximum(np.diag(pooled), 1e-3))
    factors, offsets = [], []
    for label in (0, 1):
        mixed = (1 - TO_POOLED) * scatters[label] + TO_POOLED * pooled
        shrunk = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diag(mixed)) + floor
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(counts[label] / n) - np.log(np.diag(lower)).sum()))
    return Discriminant((means[0], means[1]), tuple(factors), tuple(offsets))


def score(measured: DataFrame, model: Discriminant | None) -> DataFrame:
    """measured with `score`, the probability of label 1; 0.5 without a model."""
    if model is None:
        return measured.withColumn("score", F.lit(0.5))
    schema = T.StructType([*measured.schema.fields, T.StructField("score", T.DoubleType())])
    at = measured.columns.index("x")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, -1)
                odds = np.clip(model.log_odds(x), -50, 50)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-odds)))], names=schema.names)

    return measured.mapInArrow(run, schema)
