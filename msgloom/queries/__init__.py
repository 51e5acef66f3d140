"""Queries over the driver's tables, one for each operator, and their SQL."""
