"""Training-data operators on documents (see README, "LLM data pipeline").

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Every operator works on a documents-like DataFrame; the thin queries that the
driver runs are in ``queries.py``.
"""
