"""Column expressions: dates, predicates and report metrics."""
