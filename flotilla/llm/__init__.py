"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; its queries are listed
in :mod:`flotilla.llm.queries`.
"""
