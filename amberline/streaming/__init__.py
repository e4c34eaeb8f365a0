"""Incremental versions of the nightly steps (Structured Streaming)."""
