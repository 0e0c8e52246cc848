"""The same operators over unbounded input, with Structured Streaming."""
