"""All queries of the core and their SQL."""

from __future__ import annotations

from . import benchmarks, functions, operators, relational, rewrites, sources, storage  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
