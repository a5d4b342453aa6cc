"""Stable identifiers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix + the first hex digits of SHA-256 over parts joined by unit separators."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.sha2(F.concat_ws(SEP, *filled), 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, length))


def transition_id(source: Column, target: Column) -> Column:
    return stable_id("transition-", 12, source, target)


def node_id(activity: Column) -> Column:
    return stable_id("activity-", 12, activity)


def normalise_key(key: Column) -> Column:
    """Trim, lower-case, and write '-' and ' ' as '_'."""
    return F.translate(F.lower(F.trim(key)), "- ", "__")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of one row; nulls and column borders are kept apart."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
