"""Registered queries over the shared parquet tables, each with a SQL twin where one exists."""
