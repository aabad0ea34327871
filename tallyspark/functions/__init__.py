"""Typed expressions as Spark columns, and extension functions."""
