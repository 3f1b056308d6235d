"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import assembly_queries, cohort_queries, evaluation_queries, graph_queries, learning_queries, result_queries, series_queries, signal_queries, spectral_queries, stream_queries, wider_queries

FLAGSHIP = "sp06_band_stats"
PARTS = (cohort_queries, spectral_queries, series_queries, evaluation_queries, graph_queries, result_queries, learning_queries, signal_queries, stream_queries, assembly_queries, wider_queries)


def queries() -> dict:
    return {name: q for part in PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
