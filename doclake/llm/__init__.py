"""Operators for large training-data corpora: one module each, with queries in ``queries.py``.

Nothing else in the package imports this subpackage, so it can be left out.
"""
