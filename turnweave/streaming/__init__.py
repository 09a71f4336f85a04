"""Structured Streaming counterparts of the refresh and stale-run operators."""
