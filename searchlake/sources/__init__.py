"""Sources of searchlake."""
