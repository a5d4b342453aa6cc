"""Pairing of events and merging of intervals, with windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import scan
from ..session import Scale


def fifo_pairs(rows: DataFrame, request: str, response: str, scale: Scale) -> DataFrame:
    """Each request with the earliest response after it that no earlier request took.

    A response is left over exactly when the surplus of responses over requests
    reaches a new maximum above zero; the j-th request then belongs to the j-th
    response that is not left over.
    """
    kind = F.col("event_type")
    pairable = rows.where(kind.isin(request, response))
    counted = scan(
        pairable,
        ["case_id"],
        ["pos"],
        scale,
        running={
            "_req": F.when(kind == request, 1).otherwise(0),
            "_resp": F.when(kind == response, 1).otherwise(0),
        },
    )
    surplus = scan(
        counted, ["case_id"], ["pos"], scale, peak={"_peak": F.col("_resp") - F.col("_req")}
    )
    used_upto = F.col("_resp") - F.greatest(F.lit(0), F.col("_peak"))
    ranked = surplus.withColumn("_used", used_upto)
    stepped = scan(ranked, ["case_id"], ["pos"], scale, previous={"_used_before": F.col("_used")})
    is_used = (kind == response) & (F.col("_used") > F.coalesce("_used_before", F.lit(0)))
    keyed = stepped.select(
        "case_id",
        F.when(kind == request, F.col("_req")).when(is_used, F.col("_used")).alias("_rank"),
        F.when(kind == request, F.struct("event_at", "event_id")).alias("_q"),
        F.when(is_used, F.struct("event_at", "event_id")).alias("_a"),
    ).where(F.col("_rank").isNotNull())
    got = keyed.groupBy("case_id", "_rank").agg(F.max("_q").alias("_q"), F.max("_a").alias("_a"))
    return got.select(
        "case_id",
        F.col("_rank").alias("rank"),
        F.col("_q.event_at").alias("request_at"),
        F.col("_q.event_id").alias("request_id"),
        F.col("_a.event_at").alias("response_at"),
        F.col("_a.event_id").alias("response_id"),
    )


def next_match(rows: DataFrame, of: str, to: str, name: str, scale: Scale) -> DataFrame:
    """Rows of type `of` with the time of the next row of type `to` (shared matches allowed)."""
    hit = F.when(F.col("event_type") == to, F.col("event_at"))
    return scan(rows, ["case_id"], ["pos"], scale, ahead={name: hit}).where(F.col("event_type") == of)


def merge_intervals(
    df: DataFrame, key: str, start: str, end: str, scale: Scale
) -> DataFrame:
    """Union of the intervals of each key; overlapping and touching ones become one."""
    # intervals with equal bounds are indistinguishable: count them once
    distinct = df.groupBy(key, start, end).agg(F.count(F.lit(1)).alias("_n"))
    reach = scan(distinct, [key], [start, end], scale, peak={"_reach": F.col(end)})
    before = scan(reach, [key], [start, end], scale, previous={"_before": F.col("_reach")})
    opens = F.when(F.col(start) <= F.col("_before"), 0).otherwise(1)
    numbered = scan(
        before.withColumn("_opens", opens), [key], [start, end], scale, running={"_island": F.col("_opens")}
    )
    return (
        numbered.groupBy(key, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("merged"))
        .drop("_island")
    )
