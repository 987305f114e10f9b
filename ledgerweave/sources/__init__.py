"""Readers of document formats and the result sinks."""
