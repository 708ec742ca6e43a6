"""Column functions: text, picks, regex spans and small statistics."""
