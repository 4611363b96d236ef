"""Registered queries (Spark) and their SQL oracles (DuckDB dialect)."""
