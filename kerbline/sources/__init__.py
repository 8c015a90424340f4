"""Readers, provenance stamping and table writers."""
