"""Operators for training-data pipelines over web-scale text."""
