"""All queries of the core and their SQL."""

from docloom.plans import queries, queries_flow, queries_store  # noqa: F401

QUERIES, SQL = queries.QUERIES, queries.SQL
