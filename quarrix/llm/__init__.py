"""Operators for preparing language-model training data.

Every module here offers one operator with a general interface; ``queries``
applies them to the synthetic tables.  Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it.
"""
