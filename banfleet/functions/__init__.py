"""Column functions: everything here maps columns to a column, row by row."""
