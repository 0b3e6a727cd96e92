"""Training-data operators: filters, scans, near-duplicate search, mixing and token output."""
