"""Queries over whole tables and their DuckDB twins."""
