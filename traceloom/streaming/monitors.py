"""Windowed and timer-like monitors on streams, and a way to run them to the end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder
from ..sources.sinks import path_exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a micro-batch that one task sorts by key and takes into its part of the state.
STATE_ROWS = 250_000


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a file stream; zone-less timestamps become UTC timestamps."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    naive = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({n: F.col(n).cast("timestamp") for n in naive}) if naive else raw


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB, rows: int = 0):
    """Streams started inside use this state store; afterwards the session's own choice holds again.

    rows: how many a micro-batch may have.  The partitions of state are fixed when a stream is begun,
    so there are as many as such a batch needs, and no fewer than the session's shuffle partitions.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // STATE_ROWS))
    wanted = {"spark.sql.streaming.stateStore.providerClass": provider, "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_end(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process all available input and return what was emitted, with its batch number.

    Each micro-batch is written below the shared folder under its own number, so
    a repeated batch replaces itself.  Nothing is gathered in the driver.
    """
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if not path_exists(spark, out):  # no input since the checkpoint
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name for a folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def replay(
    rows: DataFrame,
    order: str,
    parts: int,
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    checkpoint: str | None = None,
    closing: DataFrame | None = None,
    cuts: Sequence[datetime] | None = None,
) -> DataFrame:
    """Let rows arrive in `parts` portions by the time `order` and run a stream over each; all that was emitted.

    Cuts are the last times of all portions but the last one; without any, portions are of like size.

    The portions are written one after the other to a folder that the stream reads, each by as many
    tasks as it needs, and every run goes on from the checkpoint of the one before.  Closing rows
    come last, on their own: with a late time they let everything that waits for the watermark go.
    """
    spark = rows.sparkSession
    base = new_folder(spark, "replay")
    source, place = f"{base}/arrived", checkpoint or f"{base}/checkpoint"
    micros = F.unix_micros(order)
    if cuts is not None:
        ends = [F.unix_micros(F.lit(cut).cast("timestamp")) for cut in cuts]
    else:
        shares = [i / parts for i in range(1, parts)]
        times = rows.select(micros.cast("double").alias("t"))
        ends = [F.lit(t) for t in (times.stat.approxQuantile("t", shares, 0.001) if shares else [])]
    number = F.lit(0)
    for end in ends:
        number = number + (micros > end).cast("int")
    portions = [rows.where(F.coalesce(number, F.lit(0)) == part) for part in range(parts)]
    emitted = []
    for portion in [*portions, closing] if closing is not None else portions:
        portion.write.mode("append").parquet(source)
        emitted.append(run_to_end(build(spark.readStream.schema(rows.schema).parquet(source)), mode, place))
    return reduce(DataFrame.unionByName, emitted)


def latest_update(emitted: DataFrame, key: list[str]) -> DataFrame:
    """The last version of each row of an update-mode stream."""
    rest = [c for c in emitted.columns if c not in (*key, "batch")]
    got = emitted.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return got.select(*key, "_r.*")


def tumbling_quality(snapshots: DataFrame, length: str = "7 days", watermark: str = "1 hour") -> DataFrame:
    """Snapshot quality per fixed window of arrival time."""
    return (
        snapshots.withWatermark("available_at", watermark)
        .groupBy(F.window("available_at", length).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("snapshots"),
            F.count_if(F.col("freshness") == "fresh").alias("fresh"),
            F.count_if(F.col("conflict_status") == "detected").alias("conflicts"),
            F.count_if(F.size("source_warning_codes") > 0).alias("warned"),
        )
        .select(F.col("w.start").alias("window_start"), "snapshots", "fresh", "conflicts", "warned")
    )


def sessions(events: DataFrame, user: str, ts: str, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap with their size (batch or stream)."""
    return (
        events.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("w"), user)
        .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_at"))
        .select(user, F.col("w.start").alias("first_at"), "last_at", "events")
    )


def retry_dedup(snapshots: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One row per (record, version) within the watermark, for use without a suppressed row."""
    return snapshots.withWatermark("available_at", watermark).dropDuplicatesWithinWatermark(
        ["source_record_identifier", "source_record_version"]
    )
