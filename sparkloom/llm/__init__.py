"""Training-data operators: near-duplicates, repeats, filters, tokens, mixing and sharding."""
