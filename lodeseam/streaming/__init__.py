"""Incremental statistics over Structured Streaming."""
