"""Filters, windows, reports and counts over lines.

A table of lines has ``file`` (the key), ``path`` (the physical file), ``number`` (1-based, in the path) and
``text``; where a file has several paths, ``seg`` orders them.
"""
