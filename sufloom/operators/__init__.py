"""Suffix arrays, index tables and pattern search."""
