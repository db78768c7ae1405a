"""Training-data operators: filtering, deduplication, mixing, tokens, pages and archives.

Nothing outside this subpackage imports it.
"""
