"""Training-data operators: sharding, filtering, deduplication, packing, formatting."""
