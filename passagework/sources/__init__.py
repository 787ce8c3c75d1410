"""Readers of document folders and the stored passage collection."""
