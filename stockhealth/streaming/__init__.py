"""Incremental maintenance with Structured Streaming."""
