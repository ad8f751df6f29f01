"""Training-data operators: sharding, filters, dedup, scans, tokens and packing.

Nothing outside this subpackage imports it.
"""
