"""Predicates, their text form, quality measures and scalar functions."""
