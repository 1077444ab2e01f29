"""Training-data operators: filtering, encoding, deduplication, sharding and packing of a document corpus."""
