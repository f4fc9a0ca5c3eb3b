"""Training-data operators: search, deduplication, privacy, scoring, sharding, tokens, packing."""
