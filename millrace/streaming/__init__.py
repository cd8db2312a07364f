"""Structured Streaming operators and the runner that drains a stream to files."""
