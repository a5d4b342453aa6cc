"""Language by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams of one to three characters, in order.  A text's own
most frequent n-grams are held against each profile: an n-gram costs how far its ranks are apart,
or the profile's length if the profile lacks it.  The profile with the smallest mean cost wins.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: N-grams of a profile and of a text.
RANKS = 400
UNKNOWN = "und"
#: Everything that is no letter, numerals such as a half or a circled one too.
_OTHER = regex.compile(r"\P{L}+")
#: Characters counted at once, so that long texts need no more memory.
BLOCK = 1 << 20


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, count) of the letters of a text, each word between spaces; 21 bits per character."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    if not plain.strip():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    found, many = [], []
    for at in range(0, len(code), BLOCK):
        c = code[at : at + BLOCK + 2]
        own = min(BLOCK, len(c))
        two = (c[:-1] << 21 | c[1:])[:own]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:own]
        keys, counts = np.unique(np.concatenate([c[:own][c[:own] != 32], two, three]), return_counts=True)
        found.append(keys)
        many.append(counts)
    if len(found) == 1:
        return found[0], many[0]
    return total(found, many)


def total(found: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(many)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams first, equal counts by their code."""
    return keys[np.lexsort((keys, -counts))[:RANKS]]


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Language -> its n-grams by rank, from all rows with text and language.

    Each task adds up the n-grams of its batches per language, so what is shuffled is bounded by
    the alphabets, not by the texts.  The result has RANKS numbers per language.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.where("lang is not null and _text is not null")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            per: dict[str, list] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = per.setdefault(name, [[], []])
                keys, counts = grams(body.as_py())
                part[0].append(keys)
                part[1].append(counts)
                if len(part[0]) >= 500:
                    keys, counts = total(*part)
                    per[name] = [[keys], [counts]]
            for name, part in per.items():
                keys, counts = total(*part)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RANKS).collect()
    out: dict[str, np.ndarray] = {}
    for name in sorted({r["lang"] for r in best}):
        out[name] = np.array([r["gram"] for r in sorted((r for r in best if r["lang"] == name), key=lambda r: r["rank"])], np.int64)
    return out


class Judge:
    """Profiles laid out for searching."""

    def __init__(self, known: dict[str, np.ndarray]) -> None:
        self.names = sorted(known)
        order = [np.argsort(known[n]) for n in self.names]
        self.keys = [known[n][o] for n, o in zip(self.names, order)]
        self.ranks = order

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text)) if text else np.zeros(0, np.int64)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.arange(len(own))
        costs = []
        for keys, ranks in zip(self.keys, self.ranks):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            costs.append(np.where(keys[at] == own, np.minimum(np.abs(ranks[at] - place), RANKS), RANKS).mean())
        best = int(np.argmin(costs))  # equal costs: the first name
        return self.names[best], float(1 - costs[best] / RANKS)


def predict(docs: DataFrame, known: dict[str, np.ndarray], text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score (1 less the mean cost as a share of the highest).

    `und` with score 0 for null texts, texts without a letter, and where nothing was learned.
    """
    judge = Judge(known)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    kept = list(source.schema.fields[:-1])
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return source.mapInArrow(run, schema)
