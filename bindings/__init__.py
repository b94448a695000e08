"""Binding of the operators to the driver's tables, with a DuckDB statement for each."""
