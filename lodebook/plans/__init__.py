"""Whole jobs: building an index, answering a query, and the query catalogue."""
