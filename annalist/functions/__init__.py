"""Column expressions: dates, text, vectors, urls, scores."""
