"""Column expressions: null rules, dates, rounding, text, aggregates."""
