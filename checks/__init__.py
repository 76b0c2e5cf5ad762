"""Inputs derived from the given tables, queries over them and the SQL they are checked with."""
