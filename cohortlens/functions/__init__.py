"""Column expressions: columns in, columns out."""
