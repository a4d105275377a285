"""Queries over the given tables: derived recordings, the query registry and its reference SQL."""
