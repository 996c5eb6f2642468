"""Column functions: expressions over strings, arrays and numbers."""
