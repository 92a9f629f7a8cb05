"""Column functions: distributions, missing values, their SQL twins for checks."""
