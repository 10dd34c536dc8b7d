"""Column functions without UDFs."""
