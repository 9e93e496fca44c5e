"""The registered queries, each next to the SQL that checks it."""

from catalog import dedup, documents, generation, rows, runs, sources, validation
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dedup", "documents", "generation", "rows", "runs", "sources", "validation"]
