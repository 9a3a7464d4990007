"""The registered queries: one module per theme, each with its DuckDB counterpart."""

from . import detection, edge_cases, file_jobs, files, masking, monitoring, redaction, restoring, streams  # noqa: F401
from .registry import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
