"""Versioned tables, search and relational analytics on PySpark."""
