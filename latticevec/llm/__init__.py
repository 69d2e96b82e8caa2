"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage; the queries that drive it
are in :mod:`latticevec.llm.queries`.
"""
