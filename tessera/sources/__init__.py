"""Readers of tables, windows, score slices and raw archives."""
