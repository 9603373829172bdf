"""Readers, writers and changes of stored tables."""
