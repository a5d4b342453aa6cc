"""All registered queries and their check statements."""

from __future__ import annotations

from . import queries_intake, queries_log, queries_mining, queries_opportunity, queries_review  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
