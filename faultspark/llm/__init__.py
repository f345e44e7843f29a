"""Operators for training-data pipelines over text. Nothing else in the library imports this package."""
