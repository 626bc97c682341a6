"""Queries over whole tables, with the SQL they are checked against."""
