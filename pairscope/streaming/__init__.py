"""Ingest of event tables by Structured Streaming."""
