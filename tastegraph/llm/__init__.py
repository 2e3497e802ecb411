"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; removing it (with
``tests/llm`` and ``corpus_pipeline.py``) leaves the rest working.
"""
