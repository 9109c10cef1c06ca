"""Training-data operators: dedup, extraction, tokenization, formatting and filtering.

Nothing outside this subpackage imports it, apart from the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
