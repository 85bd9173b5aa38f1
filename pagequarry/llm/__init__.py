"""Training-data operators: dedup, filtering, tokenising, search, media and packing."""
