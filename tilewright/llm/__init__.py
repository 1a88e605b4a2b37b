"""Operators for training-data pipelines on text. Nothing else in the library imports this subpackage."""
