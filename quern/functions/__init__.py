"""Column functions: text, numbers and dates."""
