"""Operators for training-data corpora: counting, sharding, filtering, extraction, search, packing, near copies.

Nothing else in the package imports this folder.
"""
