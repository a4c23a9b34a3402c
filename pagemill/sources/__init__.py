"""pagemill.sources."""
