"""Operators of a large-scale training-data pipeline.

Nothing else in ``factloom`` imports this subpackage.
"""
