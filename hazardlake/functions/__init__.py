"""Column expressions: scalar rules, fixed value tables and hashing."""
