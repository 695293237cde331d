"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this package; ``queries.py`` holds the
registered queries and their DuckDB SQL.
"""
