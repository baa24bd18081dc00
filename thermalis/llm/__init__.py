"""Training-data operators: scoring, filtering, tokenising, near-duplicates, output."""
