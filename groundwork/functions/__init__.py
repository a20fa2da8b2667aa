"""Column functions and the few Arrow UDFs."""
