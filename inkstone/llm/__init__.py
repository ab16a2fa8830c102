"""Operators for large training-data pipelines; nothing else in inkstone imports this subpackage."""
