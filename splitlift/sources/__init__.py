"""Readers, sinks and raw-shaped inputs derived from the given tables."""
