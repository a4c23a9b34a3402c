"""pagemill.plans."""
