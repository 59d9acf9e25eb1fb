"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Operators are functions
from DataFrames to DataFrames; the registered queries live in ``queries``.
"""
