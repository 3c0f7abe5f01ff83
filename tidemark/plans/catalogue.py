"""Registered queries of the engine and their SQL."""

from tidemark.plans import relational, tables

QUERIES = relational.QUERIES | tables.QUERIES
SQL = relational.SQL | tables.SQL
