"""Training-data operators: deduplication, filtering, scoring, tokenising and token files."""
