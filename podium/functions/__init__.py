"""Column expressions and column-name rules (driver-side, no jobs)."""
