"""Reading and writing case tables."""
