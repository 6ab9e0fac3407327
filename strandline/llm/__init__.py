"""Operators for large training-data pipelines.

Nothing outside this folder imports it, and it imports nothing from the rest of
the package, so it can be removed as a whole.
"""
