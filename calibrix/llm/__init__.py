"""Operators of a training-data pipeline over web pages and documents.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Each module holds one operator
with its general interface; ``queries.py`` applies each one to whole tables.
"""
