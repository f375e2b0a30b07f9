"""Operators of a training-data pipeline over text corpora and embeddings.

Nothing outside this subpackage imports it.  ``rasterlake.llm.queries`` holds the
registry that the entry module adds when the subpackage is present.
"""
