"""Compositions of operators, the query registry and the comparison SQL."""
