"""Training-data operators: search, packing, filters, near-duplicates, mixing, formatting, counting, scoring."""
