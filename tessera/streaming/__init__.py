"""Triples that arrive as a stream."""
