"""Column expressions: uniform draws, closed forms, small-sample formulas."""
