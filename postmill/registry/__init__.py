"""Queries registered with the driver and their DuckDB counterparts."""
