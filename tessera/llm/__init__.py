"""Training-data operators: tokens, quality, privacy, duplicates, layout, packing and media."""
