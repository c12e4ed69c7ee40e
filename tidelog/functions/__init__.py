"""Column expressions: payload fields, keys, label parsing."""
