"""Column expressions: patterns, listing fields, infobox fields, numbers, URLs and tokens."""
