"""Training-data operators: extraction, cleaning, near duplicates, tokens, archives and vector search."""
