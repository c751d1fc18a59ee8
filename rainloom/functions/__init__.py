"""Column-in, column-out helpers; everything stays in built-in Spark expressions."""
