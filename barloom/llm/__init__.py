"""Training-data operators: search, scoring, deduplication, formatting and packing of text."""
