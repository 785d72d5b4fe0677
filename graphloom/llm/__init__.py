"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  The queries that apply
the operators to the driver's tables are in :mod:`graphloom.llm.queries`.
"""
