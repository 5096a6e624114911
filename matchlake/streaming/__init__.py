"""Incremental ingest of new match files."""
