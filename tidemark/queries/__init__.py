"""Registered queries: each runs an operator over the given tables and, where plain SQL
can say the same, carries that SQL beside it."""

from tidemark.queries.registry import ORACLES, QUERIES
from tidemark.queries import scans, sinks, shaping, deltas, parity, logs, plans, runs, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
