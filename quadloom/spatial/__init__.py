"""Hilbert curve, WKT, coverage and shape operators."""
