"""Structured Streaming: ingestion, windows, and per-tenant state."""
