"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; modules are imported one by one so that a
worker that needs one operator does not load the others.
"""
