"""Streams of patterns against a stored index."""
