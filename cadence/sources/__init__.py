"""Readers, writers and the views that adapt the given tables."""
