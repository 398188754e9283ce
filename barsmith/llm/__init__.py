"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each ``opN`` module holds one
operator with a general interface, the thin registered query built on it and,
where SQL can say the same, that SQL.
"""
