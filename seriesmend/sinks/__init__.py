"""Change exports and atomic writes."""
