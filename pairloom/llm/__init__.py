"""Operators for training-data pipelines.

Each module holds one operator with its general interface; ``queries`` registers the
thin contract queries.  Nothing outside this folder imports it.
"""
