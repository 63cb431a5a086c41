"""Training-data operators: identification, packing, filtering, scoring, deduplication and mixing.

Nothing outside this subpackage imports it.
"""
