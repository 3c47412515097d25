"""Compositions of operators: stages, the mart and its queries."""
