"""Compositions of operators: reports, batch load, training, scoring."""
