"""Streaming of searchlake."""
