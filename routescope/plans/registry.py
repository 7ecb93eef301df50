"""All queries of the core library with their SQL."""

from __future__ import annotations

from routescope.plans import payloads, records, standin

QUERIES = records.QUERIES | payloads.QUERIES | standin.QUERIES
ORACLE = records.ORACLE | payloads.ORACLE | standin.ORACLE
ENTRY = payloads.embedding_search
