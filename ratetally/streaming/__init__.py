"""Continuous ingest with Structured Streaming."""
