"""Column-level expressions: identity, text, time and classification."""
