"""Operators for large training-data pipelines.

Each module holds one operator with its own general interface; ``registry`` holds the thin queries
that apply them to whole tables, and ``oracles`` their SQL. Nothing else in the library imports this
subpackage.
"""
