"""All queries outside the training-data operators, and their SQL."""

from __future__ import annotations

from tessera.plans import comm_queries, more_queries, record_queries

QUERIES = {**comm_queries.QUERIES, **record_queries.QUERIES, **more_queries.QUERIES}
ORACLES = {**comm_queries.ORACLES, **record_queries.ORACLES, **more_queries.ORACLES}
