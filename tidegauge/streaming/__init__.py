"""The ingest edge as Structured Streaming."""
