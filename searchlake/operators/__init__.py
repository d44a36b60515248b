"""Operators of searchlake."""
