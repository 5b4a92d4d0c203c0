"""Registered queries: one per operator, run on the given tables, most with an SQL counterpart."""

from __future__ import annotations

from millrace.catalog import corpus, evaluation, mixing, running, samples, stores, streams  # noqa: F401
from millrace.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
