"""Training-data operators: deduplication, sharding, packing, language, quality, privacy, media.

Nothing outside this subpackage imports it.
"""
