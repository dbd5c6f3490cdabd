"""Physical layout helpers and the correction log."""
