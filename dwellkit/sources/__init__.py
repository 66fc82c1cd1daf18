"""Reading and writing tables, and row extraction from page text."""
