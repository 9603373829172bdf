"""Streams of edited documents."""
