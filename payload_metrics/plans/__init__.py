"""Whole runs over payloads, and monitoring over their results."""
