"""Operators for large-scale training-data preparation.

Nothing outside this package imports it. Registered queries live in
:mod:`tempograph.llm.queries`.
"""
