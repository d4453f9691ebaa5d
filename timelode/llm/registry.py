"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}
for _name in ("nearest_time", "similar_vectors", "formatting_copies", "speaker_turns", "personal_information", "packing", "mixing"):
    _module = importlib.import_module(f"timelode.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
