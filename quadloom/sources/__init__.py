"""Readers, writers and virtual quad sources."""
