"""Training-data operators: scoring, tokenising, packing, de-duplication, formatting and extraction."""
