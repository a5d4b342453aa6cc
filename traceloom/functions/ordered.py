"""Ordered scans over keys that may be far too large for one task.

``scan`` adds ordered columns (position, neighbours, running values) per key.
Where the measured bounds say that every key fits a task, it uses plain windows
and starts no job of its own.  Otherwise ordinary keys still do, and a key with more rows than ``scale.limit`` is
range-partitioned by (key, order) into chunks; each chunk is scanned on its own
and one summary row per chunk carries the state across chunk borders.  Results
are identical in both forms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scale, pin

Exprs = Mapping[str, Column]


def scan(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    scale: Scale,
    *,
    position: str | None = None,
    previous: Exprs | None = None,
    following: Exprs | None = None,
    running: Exprs | None = None,
    peak: Exprs | None = None,
    carry: Exprs | None = None,
    ahead: Exprs | None = None,
    totals: Exprs | None = None,
    highest: Exprs | None = None,
    cluster: Sequence[str] = (),
) -> DataFrame:
    """Add ordered columns per key.

    ``cluster`` names a prefix of the key that later steps are keyed by: the rows
    are then distributed by it once, and neither this scan nor those steps need
    another exchange (unless one of its values is too large for a task).

    position   0-based row number
    previous   value on the row before        following  value on the row after
    running    sum up to and with this row    totals     sum over the whole key
    peak       largest value so far           highest    largest over the whole key
    carry      last non-null value up to and with this row
    ahead      first non-null value strictly after this row
    """
    parts = {
        "previous": dict(previous or {}),
        "following": dict(following or {}),
        "running": dict(running or {}),
        "peak": dict(peak or {}),
        "carry": dict(carry or {}),
        "ahead": dict(ahead or {}),
        "totals": dict(totals or {}),
        "highest": dict(highest or {}),
    }
    if cluster and (scale.fits(*cluster) or not _oversized(df, cluster, scale)):
        if list(cluster) != [scale.stored_by]:
            df = df.repartition(*cluster)
        return _plain(df, list(key), list(order), position, parts)
    if scale.fits(*key):
        return _plain(df, list(key), list(order), position, parts)

    # a struct key, because its equality also matches keys with nulls in the joins below
    keyed = df.withColumn("_key", F.struct(*key))
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = pin(counts.where(F.col("_n") > scale.limit))
    hot_rows = hot.agg(F.sum("_n")).first()[0]
    if not hot_rows:
        return _plain(df, list(key), list(order), position, parts)
    keys = hot.select("_key")
    cold = _plain(keyed.join(keys, "_key", "left_anti"), ["_key"], list(order), position, parts)
    split = max(2, -(-2 * hot_rows // scale.limit))
    wide = _chunked(
        keyed.join(keys, "_key", "left_semi"), ["_key"], list(order), position, parts, int(split)
    )
    return cold.unionByName(wide.select(*cold.columns)).drop("_key")


def _oversized(df: DataFrame, key: Sequence[str], scale: Scale) -> bool:
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.where(F.col("_n") > scale.limit).isEmpty()


def _ordered_columns(by, order, position, parts) -> dict[str, Column]:
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what lies ahead is what came before in reversed order: a running frame, linear in the rows
    back = Window.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) for c in order])
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    out: dict[str, Column] = {}
    if position:
        out[position] = (F.row_number().over(w) - 1).cast("long")
    out |= {n: F.lag(e).over(w) for n, e in parts["previous"].items()}
    out |= {n: F.lead(e).over(w) for n, e in parts["following"].items()}
    out |= {n: F.sum(e).over(upto) for n, e in parts["running"].items()}
    out |= {n: F.max(e).over(upto) for n, e in parts["peak"].items()}
    out |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in parts["carry"].items()}
    out |= {n: F.last(e, ignorenulls=True).over(after) for n, e in parts["ahead"].items()}
    return out


def _plain(df, key, order, position, parts) -> DataFrame:
    out = _ordered_columns(key, order, position, parts)
    # same frame as the ordered windows' partitioning: no further exchange
    whole = Window.partitionBy(*key)
    out |= {n: F.sum(e).over(whole) for n, e in parts["totals"].items()}
    out |= {n: F.max(e).over(whole) for n, e in parts["highest"].items()}
    return df.withColumns(out)


def _chunked(df, key, order, position, parts, split: int) -> DataFrame:
    ranged = df.repartitionByRange(split, *key, *order)
    # chunk numbers depend on sampled range bounds, so fix them once and for all
    rows = pin(ranged.withColumn("_chunk", F.spark_partition_id()))
    at = F.struct(*order)

    local = _ordered_columns(key + ["_chunk"], order, "_local", parts)
    rows_local = rows.withColumns(local)

    edge = {**parts["previous"], **parts["following"]}
    aggs = [F.count(F.lit(1)).alias("_size")]
    if edge:
        values = F.struct(*[e.alias(n) for n, e in edge.items()])
        aggs += [F.min_by(values, at).alias("_head"), F.max_by(values, at).alias("_tail")]
    for name, e in {**parts["running"], **parts["totals"]}.items():
        aggs.append(F.sum(e).alias(f"_sum_{name}"))
    for name, e in {**parts["peak"], **parts["highest"]}.items():
        aggs.append(F.max(e).alias(f"_max_{name}"))
    for name, e in parts["carry"].items():
        aggs.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_last_{name}"))
    for name, e in parts["ahead"].items():
        aggs.append(F.min_by(e, F.when(e.isNotNull(), at)).alias(f"_first_{name}"))
    chunks = rows.groupBy(*key, "_chunk").agg(*aggs)

    w = Window.partitionBy(*key).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*key).orderBy(F.desc("_chunk"))
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    state: dict[str, Column] = {"_offset": F.coalesce(F.sum("_size").over(before), F.lit(0))}
    if edge:
        state |= {"_in": F.lag("_tail").over(w), "_out": F.lead("_head").over(w)}
    state |= {f"_b_{n}": F.sum(f"_sum_{n}").over(before) for n in parts["running"]}
    state |= {f"_b_{n}": F.max(f"_max_{n}").over(before) for n in parts["peak"]}
    state |= {
        f"_b_{n}": F.last(f"_last_{n}", ignorenulls=True).over(before) for n in parts["carry"]
    }
    state |= {
        f"_b_{n}": F.last(f"_first_{n}", ignorenulls=True).over(after) for n in parts["ahead"]
    }
    state |= {n: F.sum(f"_sum_{n}").over(whole) for n in parts["totals"]}
    state |= {n: F.max(f"_max_{n}").over(whole) for n in parts["highest"]}
    borders = chunks.select(
        *key, "_chunk", "_size", *[e.alias(n) for n, e in state.items()]
    )

    joined = rows_local.join(borders, [*key, "_chunk"])
    out: dict[str, Column] = {}
    if position:
        out[position] = (F.col("_local") + F.col("_offset")).cast("long")
    first, last = F.col("_local") == 0, F.col("_local") == F.col("_size") - 1
    for name in parts["previous"]:
        out[name] = F.when(first, F.col(f"_in.{name}")).otherwise(F.col(name))
    for name in parts["following"]:
        out[name] = F.when(last, F.col(f"_out.{name}")).otherwise(F.col(name))
    for name in parts["running"]:
        out[name] = F.when(
            F.col(name).isNull() & F.col(f"_b_{name}").isNull(), None
        ).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_b_{name}"), F.lit(0)))
    for name in parts["peak"]:
        out[name] = F.greatest(F.col(name), F.col(f"_b_{name}"))
    for name in (*parts["carry"], *parts["ahead"]):
        out[name] = F.coalesce(F.col(name), F.col(f"_b_{name}"))
    return joined.withColumns(out)
