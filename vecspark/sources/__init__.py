"""Storage: versioned tables, and readers of vector files."""
