"""Registered queries by subject, each module with QUERIES and ORACLE_SQL."""
