"""Column functions: no data moves, all run inside generated code."""
