"""Column expressions: Column -> Column, no DataFrame needed."""
