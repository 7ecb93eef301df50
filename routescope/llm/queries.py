"""The queries of this subpackage and their SQL, gathered for the entry module."""

from __future__ import annotations

import importlib

MODULES = ("p1_terms", "p2_chunks", "p3_similar", "p4_clusters", "p5_pairs", "p6_neighbours", "p7_packing", "p8_leaks", "p9_sentences")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"routescope.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
