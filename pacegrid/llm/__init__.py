"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries and SQL for the
entry module.
"""
