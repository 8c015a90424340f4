"""Wiring: layer builds, adapters for the given test tables, query catalogue, oracles."""
