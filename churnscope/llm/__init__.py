"""Operators for large text corpora (training-data pipelines). Nothing else in the library imports this package."""
