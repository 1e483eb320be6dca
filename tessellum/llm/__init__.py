"""Operators for training-data pipelines; optional, nothing outside imports it."""
