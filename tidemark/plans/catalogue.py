"""All queries of the engine by name, and their SQL counterparts."""

from __future__ import annotations

from tidemark.plans import radar_queries, report_queries, text_queries, theme_queries

MODULES = (radar_queries, text_queries, theme_queries, report_queries)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
