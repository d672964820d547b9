"""Column functions: text, token arrays and vectors."""
