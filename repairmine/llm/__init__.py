"""Operators of a training-data pipeline and their queries.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
