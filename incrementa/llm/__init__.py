"""Corpus operators for training-data preparation.

Nothing outside this package imports it; the registry module of this package
hands its queries to ``__spark_entry__`` when the package is present.
"""
