"""Operators for training-data pipelines: each module holds one operator; queries.py registers them.

Nothing outside this subpackage imports it.
"""
