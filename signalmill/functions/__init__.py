"""Column functions: text, numbers and dates, fuzzy scores."""
