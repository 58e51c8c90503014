"""Dataflow operators: DataFrame in, DataFrame out, always lazy."""
