"""Operators on identification graphs, as DataFrame transformations."""
