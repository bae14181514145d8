"""All registered queries: name to (builder, SQL twin or None)."""

from __future__ import annotations

from . import clean_queries, eval_queries, flow_queries, ml_queries, sample_queries

QUERIES = {**flow_queries.Q, **clean_queries.Q, **sample_queries.Q, **eval_queries.Q, **ml_queries.Q}
