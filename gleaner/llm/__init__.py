"""Corpus operators for building training data: search, fingerprints, dedup,
mixing, packing, PII and secret scans, HTML extraction, quality models.

Nothing else in the package imports this subpackage.
"""
