"""All queries of the core and their DuckDB statements."""

from __future__ import annotations

from textloom.queries import corpora, curation, details, evaluations, parsing, planning, pools, samples, statistics, vectors  # noqa: F401
from textloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
