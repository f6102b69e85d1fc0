"""Operators for training-data pipelines: quality, addresses, media, copies, languages, pages, mixes, packing."""
