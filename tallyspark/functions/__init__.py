"""Column-to-column helpers built only from built-in Spark expressions."""
