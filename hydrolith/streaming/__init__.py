"""Structured Streaming forms of polling, deduplication, windowed counts and staleness."""
