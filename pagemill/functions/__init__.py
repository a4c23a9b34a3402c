"""pagemill.functions."""
