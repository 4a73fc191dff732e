"""A PySpark-native engine for searching, summarising and rewriting large collections of text."""
