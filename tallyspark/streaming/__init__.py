"""Incremental import with Structured Streaming."""
