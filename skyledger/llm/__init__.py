"""Operators for training-data corpora: scans, packing, extraction, duplicates, scoring."""
