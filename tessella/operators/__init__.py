"""Relational operators, and the registry of the queries that show them."""
