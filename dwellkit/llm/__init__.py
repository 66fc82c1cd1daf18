"""Operators of a training-data pipeline, each by its own method; see the README for the list."""
