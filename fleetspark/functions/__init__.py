"""Column functions: strict rolling windows and hash-based random draws."""
