"""Operators for large training-data pipelines; nothing else in carelake imports this subpackage."""
