"""Training-data operators: mixing, fingerprints, dedup, scoring, packing, filtering, scanning."""
