"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` registers one thin query per operator.
"""
