"""The same operators as Structured Streaming queries."""
