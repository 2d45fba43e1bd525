"""Operators for text corpora and approximate statistics; nothing outside imports this package."""
