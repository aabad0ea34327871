"""Grids and HTTP."""
