"""Column expressions: text rules and metric display."""
