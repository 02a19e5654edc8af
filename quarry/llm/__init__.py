"""Operators for building training corpora, one module each, and their catalogue queries.

Nothing outside this package imports it.  ``queries.QUERIES`` and ``queries.ORACLE_SQL`` are what
``__spark_entry__.py`` adds to the catalogue when the package is there.
"""
