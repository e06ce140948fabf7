"""Column functions: hashing, shingling and sizing formulas."""
