"""Query plans: compositions of operators over the driver tables, with DuckDB oracles."""
