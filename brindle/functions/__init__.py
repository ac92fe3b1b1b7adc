"""Column functions and small lookup values."""
