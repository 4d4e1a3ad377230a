"""Training-data operators: quality rules, packing, classifiers, extraction, dedup, mixing, sharding, scoring."""
