"""Training-data operators: quality, toxicity, deduplication, search, token counts and packing."""
