"""Relational operators over the trace tables."""
