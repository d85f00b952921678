"""Preparation of text corpora: quality, duplicates, leaks, secrets, packing, scoring, archives."""
