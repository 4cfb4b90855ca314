"""Column builders and Unicode helpers."""
