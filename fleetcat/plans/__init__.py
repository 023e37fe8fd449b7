"""Query plans: registered queries and their DuckDB oracle SQL."""
