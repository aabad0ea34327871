"""Requests, type checking and typed logical plans."""
