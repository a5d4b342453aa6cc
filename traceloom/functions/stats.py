"""Exact summaries and capped id lists that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scale, pin
from .ordered import scan


def label(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def summarise(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    scale: Scale,
    *,
    prefix: str = "",
    extra: Sequence[Column] = (),
    also: Mapping[str, str] | None = None,
) -> DataFrame:
    """n, mean, median, min, max and linear-interpolated percentiles per group.

    Nulls do not count.  ``also`` (prefix → column) summarises further columns and
    ``extra`` adds other aggregates, in the same pass.  Small form and large form
    give the same columns.
    """
    wanted = tuple(dict.fromkeys((0.5, *probs)))
    values = {prefix: value, **(also or {})}
    basics = [*extra]
    for p, v in values.items():
        basics += [
            F.count(v).alias(f"{p}n"),
            F.avg(v).alias(f"{p}mean"),
            F.min(v).alias(f"{p}min"),
            F.max(v).alias(f"{p}max"),
        ]
    if scale.small:
        points = F.array(*[F.lit(float(q)) for q in wanted])
        quantiles = [F.percentile(v, points).alias(f"_q_{p}") for p, v in values.items()]
        got = df.groupBy(*by).agg(*basics, *quantiles)
        for p in values:
            got = got.withColumns(_named(wanted, p, lambda i, p=p: F.col(f"_q_{p}")[i])).drop(f"_q_{p}")
        return got

    out = df.groupBy(*by).agg(*basics)
    for p, v in values.items():
        out = _with_quantiles(out, df, by, v, wanted, scale, p)
    return out


def _with_quantiles(basic, df, by, value, wanted, scale, prefix) -> DataFrame:
    exact = quantiles_by_rank(df, by, value, wanted, scale)
    named = exact.select(
        *by, *[c.alias(n) for n, c in _named(wanted, prefix, lambda i: F.col(f"_q{i}")).items()]
    )
    if not by:
        return basic.crossJoin(F.broadcast(named))  # one row each
    tagged = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    right = named.select(*tagged, *[c for c in named.columns if c not in by])
    match = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return basic.join(right, match, "left").drop(*[f"_k{i}" for i in range(len(by))])


def _named(wanted, prefix, at) -> dict[str, Column]:
    out = {f"{prefix}median": at(0)}
    out |= {f"{prefix}{label(q)}": at(i) for i, q in enumerate(wanted)}
    return out


def quantiles_by_rank(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], scale: Scale
) -> DataFrame:
    """Columns _q0.._qn: exact quantiles from global ranks of (group, value) counts."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    # stored, as the scan may look at them more than once: df itself is read once
    counted = pin(
        df.where(F.col(value).isNotNull())
        .groupBy(group.alias("_group"), F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = scan(
        counted,
        ["_group"],
        ["_v"],
        Scale(counted.count(), scale.limit),
        running={"_upto": F.col("_c")},
        totals={"_all": F.col("_c")},
    )

    def at_rank(rank: Column) -> Column:
        inside = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(inside, F.col("_v")))

    aggs = []
    for i, q in enumerate(probs):
        low = F.floor((F.col("_all") - 1) * F.lit(float(q)))
        aggs.append(at_rank(low).alias(f"_lo{i}"))
        aggs.append(at_rank(F.least(low + 1, F.col("_all") - 1)).alias(f"_hi{i}"))
    got = ranked.groupBy("_group").agg(F.max("_all").alias("_n"), *aggs)
    out = []
    for i, q in enumerate(probs):
        spot = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(f"_q{i}"))
    return got.select(*[F.col("_group")[c].alias(c) for c in by], *out)


def first_ids(df: DataFrame, by: Sequence[str], ident: str, k: int, name: str) -> DataFrame:
    """The k smallest distinct ids of each group, ascending, as an array.

    Duplicates go in a partial aggregate and ``row_number() <= k`` is applied on
    the map side too, so at most k rows per group and task are shuffled.
    """
    pairs = df.where(F.col(ident).isNotNull()).select(*by, ident).distinct()
    w = Window.partitionBy(*by).orderBy(ident)
    kept = pairs.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list(ident)).alias(name))


def mode_by(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group; the larger value wins a tie."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct("_c", value)).alias(name))
