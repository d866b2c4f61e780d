"""Registry of the engine's queries and their SQL, by family."""

from claimgraph.queries import board_queries, evaluation_queries, evidence_queries, more_queries, scope_queries, state_queries, store_queries, stream_queries, text_queries  # noqa: F401
from claimgraph.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
