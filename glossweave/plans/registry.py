"""All queries of the link-graph engine by name, and the SQL that states the same rows."""

from __future__ import annotations

from glossweave.plans import cluster_queries, graph_queries, ingest_queries

QUERIES = ingest_queries.QUERIES | cluster_queries.QUERIES | graph_queries.QUERIES
ORACLES = ingest_queries.ORACLES | cluster_queries.ORACLES | graph_queries.ORACLES
