"""All queries outside the training-data operators, and their SQL."""

from ..streaming import queries as stream_queries
from . import artifact_queries, detect_queries, health_queries, immune_queries, metric_queries, network_queries, report_queries, round_queries, rule_queries, text_queries, vector_queries

_parts = (text_queries, metric_queries, network_queries, round_queries, detect_queries, immune_queries, health_queries, report_queries, vector_queries, artifact_queries, rule_queries, stream_queries)
QUERIES = {name: f for p in _parts for name, f in p.QUERIES.items()}
SQL = {name: s for p in _parts for name, s in p.SQL.items()}
