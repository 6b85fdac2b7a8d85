"""Training-data operators: scoring, extraction, counting, packing, sharding, search and deduplication."""
