"""Training-data operators: mixing, dedup, search, filters, output formats, packing."""
