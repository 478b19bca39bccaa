"""Column functions: text, languages, JSON."""
