"""Fingerprints of tables and checks that results belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import SEP

LEVELS = (8, 5, 2, 0)


def dataset_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, fingerprint), independent of row order, sensitive to duplicates.

    Equal rows are counted first, so copies cost one entry.  The hashes are then
    combined up a tree of their own prefixes, so no step gathers more than a few
    thousand of them.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]
    level = (
        df.select(F.sha2(F.concat_ws(SEP, *parts), 256).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("d", F.sha2(F.concat_ws(":", "h", F.col("n").cast("string")), 256))
    )
    for length in LEVELS:
        level = level.groupBy(F.substring("h", 1, length).alias("h")).agg(
            F.sum("n").alias("n"),
            F.sha2(
                F.concat_ws(
                    "", F.transform(F.array_sort(F.collect_list(F.struct("h", "d"))), lambda x: x["d"])
                ),
                256,
            ).alias("d"),
        )
    return level.select(F.col("n").alias("rows"), F.col("d").alias("fingerprint"))


def join_lineage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row lineage tables: fails the job when their fingerprints differ."""
    both = a.select(F.col("fingerprint").alias("left_fp")).crossJoin(
        b.select(F.col("fingerprint").alias("right_fp"))
    )
    same = F.col("left_fp") == F.col("right_fp")
    return both.select(
        "left_fp",
        F.when(same, F.lit(True))
        .otherwise(F.raise_error(F.lit("results were computed from different inputs")).cast("boolean"))
        .alias("compatible"),
    )
