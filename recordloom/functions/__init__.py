"""Column functions and small DataFrame helpers the operators are built from."""
