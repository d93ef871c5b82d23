"""Registered queries of the library and their DuckDB oracles."""

from __future__ import annotations

from seamline.queries import change, contract, flow, review, shapes, stored, usage

_MODULES = (usage, contract, change, review, shapes, flow, stored)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
