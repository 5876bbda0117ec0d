"""Operators that prepare training text: deduplication, filters, mixing, token counts and packing."""
