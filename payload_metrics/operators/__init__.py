"""DataFrame to DataFrame steps: extract, filter, cap, dedupe, map."""
