"""Operations of a training-data pipeline: fingerprints, filters, near-duplicate joins, mixing, packing."""
