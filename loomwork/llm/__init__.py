"""Training-data operators: search, filters, scores, text extraction, mixing and deduplication."""
