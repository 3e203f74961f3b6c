"""Operators for text corpora: deduplication, consensus, matching, encoding, mixing, language."""
