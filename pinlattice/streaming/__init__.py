"""Structured Streaming forms of the append-only log, sessions and caches."""
