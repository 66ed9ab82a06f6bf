"""Incremental refresh of stored tables."""
