"""Training-data operators: filters, deduplication, tokenisation, packing and vector search.

Nothing outside this subpackage imports it.
"""
