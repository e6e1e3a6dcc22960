"""Training-data operators: filtering, deduplication, mixing, packing and archiving.

Nothing outside this subpackage imports it.
"""
