"""Operators for training-data pipelines. Nothing else in meshflow imports this subpackage."""
