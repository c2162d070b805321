"""Corpus operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and returns a lazy DataFrame; ``queries`` binds them to the test tables.
"""
