"""Operators for preparing training corpora: sharding, packing, filtering, deduplication, search, archives."""
