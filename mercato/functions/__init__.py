"""Column expressions: text, numbers and times."""
