"""Queries of the optional subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = ("q_pieces", "q_canon", "q_terms", "q_encode", "q_mixing", "q_spam", "q_turns")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = importlib.import_module(f"murmurlake.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
