"""Registered queries, by theme; each module has QUERIES and ORACLES."""
