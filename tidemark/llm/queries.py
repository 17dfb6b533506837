"""The queries of this subpackage by name, and their SQL counterparts."""

from __future__ import annotations

from tidemark.llm import chat, containment, extract, jaccard, knn, mixing, resample, shards, spelling, suffix, toxicity, units, urls

MODULES = (chat, containment, extract, jaccard, knn, mixing, resample, shards, spelling, suffix, toxicity, units, urls)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
