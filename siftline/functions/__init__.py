"""Part of the text search and transformation engine."""
