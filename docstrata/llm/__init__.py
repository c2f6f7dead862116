"""Training-data operators: de-duplication, quality, mixing, extraction, archives, packing."""
