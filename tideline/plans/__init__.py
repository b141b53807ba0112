"""Queries over the given tables: one for each operator, with the same result in SQL where SQL can express it."""
