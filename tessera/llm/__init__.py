"""Training-data operators: deduplication, mixing, quality, tokenizing, language models.

Nothing outside this subpackage imports it.
"""
