"""Queries over the given tables, each with SQL that states the same result independently."""
