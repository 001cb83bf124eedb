"""Readers, parsers and keyed writers."""
