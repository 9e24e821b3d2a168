"""Training-data operators: extraction, mixing, quality, packing, dedup, search, PII, toxicity, URLs, archives."""
