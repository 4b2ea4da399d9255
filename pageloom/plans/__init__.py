"""Whole analyses composed from the table jobs."""
