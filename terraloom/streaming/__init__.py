"""Structured Streaming forms of operators (an extension: the batch forms are the ones compared)."""
