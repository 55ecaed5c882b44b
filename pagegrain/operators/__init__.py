"""Dataflow operators on DataFrames."""
