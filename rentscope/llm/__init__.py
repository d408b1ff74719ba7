"""Operators of a large-scale training-data pipeline (documents, pages, conversations).

Nothing outside this package imports it; ``entry.py`` holds the registered queries.
"""
