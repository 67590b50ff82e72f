"""Helpers that shape physical plans: lineage cuts, spreading work, reading tables."""
