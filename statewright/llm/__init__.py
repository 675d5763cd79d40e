"""Training-data operators: sharding, deduplication, decontamination, packing, scans, encoding.

Nothing else in the library imports this subpackage.
"""
