"""Training-data operators: deduplication, decontamination, filtering, formatting and packing."""
