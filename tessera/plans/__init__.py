"""Queries over the tables, and SQL for the same rows."""
