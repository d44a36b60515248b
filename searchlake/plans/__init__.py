"""Plans of searchlake."""
