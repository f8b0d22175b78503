"""Training-data operators: sharding, scoring, scans, fixity, counts, filters, deduplication, mixing.

Nothing else in the library imports this subpackage.
"""
