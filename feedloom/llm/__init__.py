"""Training-data operators: packing, archives, filtering, search and deduplication."""
