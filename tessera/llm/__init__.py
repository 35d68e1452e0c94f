"""Operators for preparing language-model training data.

Nothing outside this package imports it. ``queries`` and ``oracle_sql`` in
``tessera.llm.registry`` hold the entries of this package.
"""
