"""Registered queries with their oracles."""

from . import compare_queries, contract_queries, ledger_queries, metric_queries, sequence_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
