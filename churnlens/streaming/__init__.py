"""Structured Streaming entry points."""

from churnlens.streaming.scoring import scored_stream, start_scoring  # noqa: F401
