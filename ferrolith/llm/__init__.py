"""Training-data operators: dedup, mixing, tokenization, filtering and search over document corpora."""
