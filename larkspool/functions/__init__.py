"""Column functions over text and token arrays."""
