"""Registered queries: each Spark plan next to the SQL it has to agree with."""

from . import (  # noqa: F401
    decision_queries, evaluation_queries, ledger_queries, quality_queries, source_queries,
    store_queries, strategy_queries, stream_queries,
)
from .registry import oracle_sql, queries  # noqa: F401
