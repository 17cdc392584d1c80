"""Training-data operators: fingerprints, near-duplicate joins, token files, packing, scoring and mixing."""
