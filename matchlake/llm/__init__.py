"""Operators for building training corpora: quality, privacy, licences, search, dedup, mixing."""
