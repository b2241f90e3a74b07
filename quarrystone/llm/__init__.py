"""Training-data operators: dedup, decontamination, filtering, formatting, sharding, packing and search.

Nothing outside this package imports it.  Queries and their SQL live in ``queries``.
"""
