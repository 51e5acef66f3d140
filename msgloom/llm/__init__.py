"""Operators for preparing large text collections.

Nothing outside this subpackage imports it. ``queries.QUERIES`` lists the registered
queries, ``queries.ORACLES`` the SQL where SQL can express one.
"""
