"""Training-data operators: quality, near and substring duplicates, decontamination, mixing, sharding, PII.

Nothing else in the library imports this subpackage.
"""
