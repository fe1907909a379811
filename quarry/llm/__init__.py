"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Its queries are listed in :mod:`quarry.llm.queries`.
"""
