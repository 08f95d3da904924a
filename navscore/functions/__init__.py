"""Column expressions: text parsing and deviation arithmetic."""
