"""SPARQL functions as Spark columns."""
