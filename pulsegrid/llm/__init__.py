"""Operators for large text corpora: deduplication, filtering, packing, tokens, vector search.

Nothing outside this folder imports it; ``pulsegrid.llm.queries`` holds the registered queries.
"""
