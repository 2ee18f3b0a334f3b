"""Operators of a training-data pipeline over the ``documents`` tables.

One module per operator; ``catalog.py`` holds the thin ``opN_<name>`` queries
and ``oracle.py`` their DuckDB SQL. Nothing outside this subpackage (and the
top-level ``corpus_pipeline.py``) imports it.
"""
