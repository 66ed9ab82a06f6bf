"""Column functions offered to factor expressions."""
