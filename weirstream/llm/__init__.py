"""Training-data operators: search, dedup, mixing, tokenising, filtering, sharding."""
