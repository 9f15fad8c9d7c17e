"""Readers, writers and the adapter to the test tables."""
