"""Training-data operators: extraction, packing, scoring, dedup, mixing, search."""
