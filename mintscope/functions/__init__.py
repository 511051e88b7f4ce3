"""Column builders: exact arithmetic, bins, text and time expressions."""
