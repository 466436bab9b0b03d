"""Operators for training-data pipelines over language-model records and texts."""
