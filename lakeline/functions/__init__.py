"""Column functions and type mappings."""
