"""Column functions: geometry, text and scale."""
