"""SPARQL text to DataFrame compiler."""
