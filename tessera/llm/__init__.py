"""Training-data operators: filtering, extraction, labelling, deduplication, search, scoring, mixing and packing."""
