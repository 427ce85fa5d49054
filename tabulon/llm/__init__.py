"""Training-data operators: archives, quality, near duplicates, privacy, tokens, mixing, scoring."""
