"""Operators that prepare training text: packing, scoring, filters and deduplication."""
