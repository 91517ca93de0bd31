"""Jobs on Structured Streaming."""
