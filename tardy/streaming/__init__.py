"""Structured Streaming: request/response topics, scoring loops, merge."""
