"""Operators for preparing training text. Nothing outside this subpackage imports it, except the
top-level ``corpus_pipeline`` and the guarded registration in ``__spark_entry__``."""
