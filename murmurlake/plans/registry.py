"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from murmurlake.plans import detect, explain, intervals, repair, tokens

FLAGSHIP = "p1_found"
_MODULES = (intervals, tokens, detect, repair, explain)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
