"""Whole dataflows, and the queries over the project's tables."""
