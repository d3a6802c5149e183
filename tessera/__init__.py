"""Byte-corpus analytics on Spark."""
