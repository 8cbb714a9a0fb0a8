"""Training-data operators: filters, deduplication, packing, sharding and search."""
