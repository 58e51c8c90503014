"""Whole jobs and queries built from the operators."""
