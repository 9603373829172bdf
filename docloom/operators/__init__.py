"""Operators over documents, chunks and terms: DataFrame in, DataFrame out."""
