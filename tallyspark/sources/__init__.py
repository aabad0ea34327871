"""Datasets: registration, files and versions."""
