"""pagemill.streaming."""
