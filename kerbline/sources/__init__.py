"""Readers for survey files and writers of what other tools read."""
