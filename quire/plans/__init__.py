"""Query registry and the DuckDB oracle SQL of each query."""
