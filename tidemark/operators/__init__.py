"""Analytic operators, one pure DataFrame function each."""
