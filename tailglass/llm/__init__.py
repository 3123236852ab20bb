"""Operators for training-data corpora (documents, pages, labels) as Spark jobs.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``entry_queries`` holds the thin queries over it.
"""
