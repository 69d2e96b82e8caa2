"""Column expressions and block arithmetic over vectors."""
