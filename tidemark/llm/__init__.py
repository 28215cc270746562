"""Operators for preparing training text: filters, classifiers, deduplication, archives, sharding, packing."""
