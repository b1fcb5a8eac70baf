"""Named queries (Spark) and their DuckDB oracles."""
