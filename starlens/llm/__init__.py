"""Operators of a training-data pipeline: one module each, with its registered query.

Nothing else in the library imports this package.  Every operator takes a DataFrame and column names and
returns a DataFrame; ``catalog`` gathers the queries.
"""
