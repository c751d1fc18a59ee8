"""Readers: tables, SQL and columnar JSON series."""
