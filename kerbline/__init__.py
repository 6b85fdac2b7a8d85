"""Kerb-parking survey analytics on Spark DataFrames."""
