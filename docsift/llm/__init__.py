"""Training-data operators: filtering, deduplication, mixing, sharding and packing."""
