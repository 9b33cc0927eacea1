"""Readers and parsers for what the evidence tables are made of."""
