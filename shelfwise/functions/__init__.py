"""Column -> Column building blocks (no Python UDFs)."""
