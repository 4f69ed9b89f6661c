"""Column expressions: dates, text normalisers, bands and ratios."""
