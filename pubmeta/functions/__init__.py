"""Column functions: text clean-up, identifiers, arrays, JSON."""
