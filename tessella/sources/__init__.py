"""Stored tables: snapshots, catalog, transactions, files."""
