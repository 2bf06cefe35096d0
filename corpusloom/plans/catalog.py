"""All registered queries of the library's operators, and their SQL."""

from corpusloom.plans import corpus_queries, retrieval_queries, streaming_queries, telemetry_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

FLAGSHIP = "e07_evaluate_retrieval"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
