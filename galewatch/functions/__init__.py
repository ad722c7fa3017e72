"""Column expressions: geometry and meteorology."""
