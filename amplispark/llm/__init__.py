"""Training-data operators: search, tokens, dedup, filters, extraction."""
