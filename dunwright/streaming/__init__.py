"""The batch operators wired to Structured Streaming."""
