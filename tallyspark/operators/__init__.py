"""Typed logical plans as DataFrames."""
