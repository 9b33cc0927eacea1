"""Column builders: numbers, text, fields, privacy."""
