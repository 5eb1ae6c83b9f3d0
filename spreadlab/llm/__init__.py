"""Operators for large text corpora: selection, deduplication, packing and formatting of training documents."""
