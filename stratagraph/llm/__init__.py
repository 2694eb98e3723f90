"""Training-data operators: quality, deduplication, safety, language and token stages."""
