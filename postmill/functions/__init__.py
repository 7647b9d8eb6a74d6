"""Column expressions: text rules, score rules and seeded ordering keys."""
