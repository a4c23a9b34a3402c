"""pagemill.operators."""
