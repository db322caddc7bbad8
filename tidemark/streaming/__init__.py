"""The event layer on Structured Streaming."""
