"""Payload sources, staged tables and output sinks."""
