"""Readers and row parsers for text and mapped CSV files."""
