"""Operators for preparing training data: output formats, filters, deduplication, mixing, packing."""
