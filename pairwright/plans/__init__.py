"""Whole inference as one plan."""
