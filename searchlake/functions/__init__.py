"""Functions of searchlake."""
