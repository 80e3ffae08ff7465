"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from lexmill.llm import leak_queries, mixture_queries, name_queries, rank_queries, scan_queries, sentence_queries, term_queries, truncation_queries

MODULES = [term_queries, rank_queries, scan_queries, sentence_queries, name_queries, scan_queries, leak_queries, mixture_queries, truncation_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
