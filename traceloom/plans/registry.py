"""Registered queries: name → (function of session and folder, check statement or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the last bit of an average cannot differ between engines."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in doubles})


def joined(column: str, sep: str = ",") -> "F.Column":
    return F.concat_ws(sep, column)
