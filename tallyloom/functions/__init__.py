"""Column expressions, column finders and the distributed ranking primitives."""
