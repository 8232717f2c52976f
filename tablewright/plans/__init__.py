"""Compositions of operators: automatic cleaning, recipes, version history."""
