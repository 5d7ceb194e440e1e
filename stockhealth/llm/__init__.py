"""Operators for building training corpora: near-duplicates, scans, tokens, search and mixing."""
