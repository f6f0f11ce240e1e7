"""Queries over the driver's tables."""

from . import check_queries, consistency_queries, document_queries, flow_queries, library_queries, lifecycle_queries, ordered_queries, record_queries, relational_queries, rule_queries, scalar_queries, statement_queries, structure_queries, text_queries

PLANS = (scalar_queries, text_queries, relational_queries, rule_queries, document_queries, check_queries, record_queries, lifecycle_queries, ordered_queries, structure_queries, flow_queries, consistency_queries, library_queries, statement_queries)
