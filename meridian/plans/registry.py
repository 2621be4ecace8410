"""Registered queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from meridian.plans import analysis_queries, function_queries, graph_queries, structure_queries

FLAGSHIP = "build_graph"
QUERIES = {**graph_queries.QUERIES, **function_queries.QUERIES, **analysis_queries.QUERIES, **structure_queries.QUERIES}
SQL = {**graph_queries.SQL, **function_queries.SQL, **analysis_queries.SQL, **structure_queries.SQL}
