"""Operators of a training-data pipeline, and their queries.

Nothing outside this subpackage imports it.
"""
