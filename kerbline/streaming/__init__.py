"""Structured Streaming entry points of the incremental operators."""
