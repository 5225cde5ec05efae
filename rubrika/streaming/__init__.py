"""Structured Streaming forms of scoring, logging and statistics."""
