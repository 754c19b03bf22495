"""Registered queries and their DuckDB oracles."""
