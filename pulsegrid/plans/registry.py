"""Queries over the given tables, one or more per operator, with the SQL they are checked against."""

from __future__ import annotations

from . import q_basic, q_features, q_models, q_signal, q_stats, q_tables  # noqa: F401
from .register import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
