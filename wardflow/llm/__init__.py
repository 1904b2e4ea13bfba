"""Training-data operators: packing, search, sharding, dedup, classifiers."""
