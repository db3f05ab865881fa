"""Column expressions. Every function takes Columns and returns a Column."""
