"""Operators of a training-data pipeline over tables of documents.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is there.
"""
