"""Operators for large-scale training-text pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
