"""Column-valued helpers. Nothing here runs Python per row."""
