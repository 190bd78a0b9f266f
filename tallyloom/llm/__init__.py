"""Operators of a training-data pipeline: text extraction, language ID, deduplication,
tokenisation, packing, output files and vector search.

Nothing else in the library imports this subpackage.
"""
