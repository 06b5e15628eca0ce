"""Operators of a training-data pipeline over ``documents``-shaped tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
