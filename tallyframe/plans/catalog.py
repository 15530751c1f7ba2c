"""Catalogue of the named queries: ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

from . import annotation_queries, measure_queries, observation_queries, registration_queries, report_queries, sequence_queries

QUERIES: dict = {}
ORACLE: dict = {}
for part in (observation_queries, sequence_queries, annotation_queries, report_queries, registration_queries, measure_queries):
    QUERIES.update(part.QUERIES)
    ORACLE.update(part.ORACLE)
