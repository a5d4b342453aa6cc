"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change inserts, deletes or revises one document; its delta is the signed difference it makes to
the totals of its group.  A batch of changes shrinks to one row per group, is written to a place of
its own and then published under its id by one mark.  A batch that is published stays as it is: the
same id again changes nothing, a writer that dies leaves nothing to be read, and of two writers of
one id one counts.  Totals are the sum over all published batches.  Nothing is read back to write a
batch, so batches of different ids may be committed at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceloom.llm.tokens import encode
from traceloom.sources.sinks import claim, claimed, claims, remove

GROUP = ("source", "lang", "tokenizer_version")
#: A change: before is null for an insert, after for a delete; both are set for a revision.
CHANGE = "source string, lang string, tokenizer_version string, before long, after long"


def counted(docs: DataFrame, path: str, texts: dict[str, str]) -> DataFrame:
    """docs without the given text columns but with a count (long) for each: texts maps text column to count column.

    Null and empty texts have 0 tokens.
    """
    kept = [f for f in docs.schema.fields if f.name not in texts]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in texts.values()]])
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{t}`") for t in texts])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = list(batch.columns[: len(kept)])
            for values in batch.columns[len(kept) :]:
                columns.append(pa.array([len(encode(v.as_py(), path)) for v in values], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def delta(changes: DataFrame) -> DataFrame:
    """Signed totals per group: n_docs and n_tokens.  Null sources and languages are groups; groups without effect go.

    A change with neither count makes no difference.
    """
    one = lambda c: F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    value = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    signed = changes.select(*GROUP, (one("after") - one("before")).alias("d"), (value("after") - value("before")).alias("t"))
    return _added(signed, "d", "t")


def _added(rows: DataFrame, docs: str, tokens: str) -> DataFrame:
    total = rows.groupBy(*GROUP).agg(F.sum(docs).alias("n_docs"), F.sum(tokens).alias("n_tokens"))
    return total.where("n_docs <> 0 or n_tokens <> 0")


def commit(changes: DataFrame, store: str, batch: str | int) -> bool:
    """Publish a batch of changes under its id; False if that id has been published before, which changes nothing."""
    if not str(batch).replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id is letters, digits, - and _")
    spark, mark = changes.sparkSession, f"{store}/published/{batch}"
    if claimed(spark, mark) is not None:
        return False
    place = f"{store}/batches/{batch}-{uuid.uuid4().hex}"
    delta(changes).write.parquet(place)
    won = claim(spark, mark, place.rsplit("/", 1)[1])
    if not won:
        remove(spark, place)
    return won


def committer(store: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: commits each micro-batch of changes under its number."""

    def run(changes: DataFrame, number: int) -> None:
        commit(changes, store, f"stream-{number}")

    return run


def totals(spark: SparkSession, store: str, batches: Iterable[str | int] | None = None) -> DataFrame:
    """The totals of the given or all published batches; groups that are empty again are left out.

    A store without batches has no totals: no rows.
    """
    schema = f"{', '.join(f'{c} string' for c in GROUP)}, n_docs long, n_tokens long"
    known = claims(spark, f"{store}/published")
    wanted = known if batches is None else {str(b) for b in batches}
    paths = [f"{store}/batches/{place}" for batch, place in known.items() if batch in wanted]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return _added(rows, "n_docs", "n_tokens")
